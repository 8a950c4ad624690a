from siltstone.plans import audit as A
from tests.compare import SF


def test_queue_is_read_from_stored_findings(spark):
    queue = A.review_queue(spark, SF)
    assert queue.inputFiles() and not [f for f in queue.inputFiles() if SF in f]
    assert queue.count() > 0
