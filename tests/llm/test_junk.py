from siltstone.llm import junk as J

SCHEMA = "doc_id long, text string, source string, host string, words int, s int, shingles int"
PROSE = "The valve of the harbour was closed in the winter, and nobody has opened it since. When the ice is gone, the keeper will try it again with the new key."
PAGES = {
    "keywords": ("best shoes, cheap shoes, shoes online, buy shoes, shoes sale, discount shoes, shoes 2026, top shoes, free shoes, " * 5, True),
    "links": ("Useful resources\n" + "\n".join(f"* [red page {i}](http://site{i}.example/a/b)" for i in range(12)), True),
    "menu": ("Home | News | Sport | Weather | Login\nMore | Maps | Mail | Cars | Jobs | Games", True),
    "tags": ("Tags: " + " ".join(f"#topic{'abcdefghij'[i % 10]}" for i in range(30)), True),
    "products": ("\n".join(f"SKU x{i} | red lamp | {i}.99 | in stock" for i in range(20)), True),
    "stuffed": ("Buy lamps official. lamps download lamps. Best lamps mirror? Get lamps price now. " * 8, True),
    "opening": (PROSE[:40] + ".\n\n" + "lamp\nred lamp\nlamp price\n" * 20, True),
    "commented": ("\n".join(f"# premium lamp counter" for _ in range(20)), True),
    "prose": (PROSE * 3, False),
    "badges": (" ".join(f"[Harbor lamp v3.{i}]" for i in range(40)), True),
    "see also": (PROSE * 4 + "\nSee also\n- https://a.example/x\n- https://b.example/y", False),
    "code": ("def area(w, h):\n    # width by height\n    return w * h\n\nclass Box:\n    size = area(2, 3)\n" * 4, False),
    "pipeline": ("$a | Where-Object { $_.Size -gt 4 } | Sort-Object Name\n" * 6, False),
    "definitions": ("\n".join(f"- `item_{i}`: The part of the machine that holds the value of the other one." for i in range(9)), False),
    "german": ("Die Brücke muss zuerst geprüft werden, weil die Ablage sonst leer bleibt. Wenn die Liste fehlt, bricht das Programm ab. " * 4, False),
    "russian": ("Если строка отсутствует, программа сообщает об ошибке и останавливается. Сначала читается папка, потому что ошибка может быть пустой. " * 3, False),
    "short": ("ok", False),
    "blank": (" \n ", False),
    "long": (PROSE * 3000, False),
}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", 1, 2, 3) for i, t, s in rows], SCHEMA)


def test_pages_by_kind(spark):
    kinds = list(PAGES)
    rows = [(10 * i + k, PAGES[n][0], f"host{k}") for i, n in enumerate(kinds) for k in range(3)] + [(1000, None, None), (1001, "", "x"), (None, "x", "y")]
    found = {r[0] for r in J.junk_pages(spark, docs(spark, rows)).collect()}
    assert {kinds[i // 10] for i in found} == {k for k, (_, junk) in PAGES.items() if junk}
    assert len(found) == 3 * sum(junk for _, junk in PAGES.values())


def test_hosts_decide(spark):
    """A list that nobody else carries is no junk; the same form with other topics on three hosts is."""
    page = lambda a, b, c: f"{a} sale; best {b}; {c} free; buy {a} {c}; top {b}; " * 9
    words = [("lamp", "rope", "sail"), ("stone", "river", "gate"), ("sheep", "wool", "loom")]
    alone = docs(spark, [(i, page(*w), "a") for i, w in enumerate(words)])
    spread = docs(spark, [(i, page(*w), h) for i, (w, h) in enumerate(zip(words, ("a", "B ", None)))])
    assert J.junk_pages(spark, alone).count() == 0
    assert {r[0] for r in J.junk_pages(spark, spread).collect()} == {0, 1, 2}
    assert all(r["replicated"] == r["list_phrases"] == r["phrases"] > 0 for r in J.page_evidence(spark, spread).collect())


def test_mixed_page_needs_most(spark):
    stuffed, prose = "Buy lamps official. lamps download lamps. Best lamps mirror? " * 4, PROSE * 6
    rows = [(i, prose + "\n" + stuffed, f"h{i}") for i in range(3)] + [(3 + i, stuffed * 6 + PROSE, f"h{i}") for i in range(3)]
    assert {r[0] for r in J.junk_pages(spark, docs(spark, rows)).collect()} == {3, 4, 5}


def test_phrases():
    p = J.Phrases()
    n, forms, places = p.of("red lamp, blue rope, old sail")
    assert n == 2 and places.sum() == 2
    assert set(forms) == set(p.of("big gate, new wool, cold loom")[1]) and not set(forms) & set(p.of("big gate | new wool | cold loom")[1])
    assert p.of("the lamp of the rope was red")[1].size == 0 and p.of("a b c d")[0] == 0 and p.of("")[0] == 0
    assert p.of("x = lamp(rope, sail) ; gate.open(3) ; y = 4")[1].size == 0
    long_text = "word " * 200_000
    assert p.of(long_text)[0] == 199_996


def test_row_of_repeated_id_is_judged_for_itself(spark):
    rows = [(1, PAGES["menu"][0], f"h{i}") for i in range(3)] + [(1, PROSE * 3, "x")]
    e = J.page_evidence(spark, docs(spark, rows)).collect()
    assert len(e) == 4 and sum(r["junk"] for r in e) == 3 and J.junk_pages(spark, docs(spark, rows)).count() == 1


def test_empty_table(spark):
    assert J.page_evidence(spark, docs(spark, [])).count() == 0


def test_verbatim_phrases(spark):
    """Tags with function words in them are no list phrases in masked form; the same words on three hosts are evidence,
    for a page of list units only."""
    tags = lambda a, b, c: f"Tags: #best of the {a} #gift for the {b} #rope on the {c} sale #stone in the {a} cheap #wool by the {b} red shop #gate at the {c} oak tall\n" * 2
    same, words = tags("lamps", "home", "sail"), [("hats", "farm", "boat"), ("pens", "desk", "case"), ("cups", "shelf", "tray")]
    rows = [(i, same.upper() if i else same.replace("of the", "of, the"), f"h{i}") for i in range(3)]
    rows += [(10 + i, tags(*w), f"h{i}") for i, w in enumerate(words)]
    rows += [(20 + i, tags("coats", "coast", "port"), f"h{i % 2}") for i in range(3)] + [(30 + i, PROSE * 3, f"h{i}") for i in range(3)]
    e = {r["doc_id"]: r for r in J.page_evidence(spark, docs(spark, rows)).collect()}
    assert {i for i, r in e.items() if r["junk"]} == {0, 1, 2}
    assert all(e[i]["verbatim"] == e[i]["phrases"] > 5 * e[i]["replicated"] for i in (0, 1, 2))
    assert all(e[30 + i]["verbatim"] == e[30 + i]["phrases"] > 0 for i in range(3))


def test_verbatim_places_are_those_counted_one_by_one(spark):
    rows = [(i, t, h) for i, (t, h) in enumerate([("a b c d e f g h", "x"), ("b c d e f q r s t", "y"), ("z B-C b c, d e! f", None), ("b c d e f b c d e f", "x"), ("g h i j k", "y"), ("", "x")])]
    hosts: dict = {}
    for _, t, h in rows:
        w = J._TOKEN.findall(t.lower())
        w = [x for x in w if J._token_class(x)[0]]
        for i in range(len(w) - 4):
            hosts.setdefault(tuple(w[i : i + 5]), set()).add(h)
    want = {i: sum(len(hosts[tuple(w[k : k + 5])]) >= J.HOSTS for k in range(len(w) - 4)) for i, t, _ in rows for w in [[x for x in J._TOKEN.findall(t.lower()) if J._token_class(x)[0]]]}
    assert {r["doc_id"]: r["verbatim"] for r in J.page_evidence(spark, docs(spark, rows)).collect()} == want and sum(want.values()) == 5
