from oddsift.plans.analyze import Parameters
from oddsift.plans.audit import AuditLog


def test_unseen_tells_requests_by_file_and_parameters(spark, tmp_path):
    a, b = Parameters(("zscore",), ("x",)).fingerprint(), Parameters(("zscore",), ("x",), (), 0.1).fingerprint()
    log = AuditLog(spark, str(tmp_path / "log"))
    asked = [("f1", a), ("f1", b), ("f2", a), ("f2", a), (None, a), ("f3", None)]
    requests = spark.createDataFrame(asked, "file_id string, fingerprint string")
    assert log.unseen(requests).count() == 6
    log.append_analyses(spark.createDataFrame([("f1", a), ("f1", a), (None, a)], "file_id string, fingerprint string"))
    left = [tuple(r) for r in log.unseen(requests).select("file_id", "fingerprint").collect()]
    assert sorted(left, key=str) == sorted(asked[1:], key=str)
    assert log.known("f1", a) and not log.known("f1", b)
