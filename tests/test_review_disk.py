from siltstone.plans import audit as A
from tests.compare import SF


def test_findings_are_stored(spark):
    """Each kind is written on its own: the result is a scan of findings, without the shuffled texts of all kinds in one plan."""
    stored = A.review_findings(spark, SF)
    assert stored.inputFiles() and not [f for f in stored.inputFiles() if SF in f]


def test_heldout_parts(spark, monkeypatch):
    """Items are met in parts; each is in one, so scores are whole."""
    rows = sorted(map(tuple, A.heldout_similar(spark, SF).collect()))
    monkeypatch.setattr(A, "GRAMS_AT_ONCE", 2000)
    assert sorted(map(tuple, A.heldout_similar(spark, SF).collect())) == rows
