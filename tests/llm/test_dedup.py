import hashlib
import re

from pyspark.sql import functions as F

from tests.llm.conftest import odd_texts
from trajspark.llm import dedup
from trajspark.session import scratch_path


def brute(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, at))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        for _, _, _, at in members:
            out.append((rows[at][0], rows[keep][0], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr), sorted((rows[min(m)[3]][0] for m in groups.values()), key=repr)


def result(groups):
    found = groups.collect()
    return (sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in found), key=repr),
            sorted((r.doc_id for r in found if r.kept), key=repr))


def test_groups_match_brute_force_on_odd_rows(docs):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(None, "a b"), (None, None), (3, "a b"), (3, "a b"), (100, "a\tb")]
    assert result(dedup.exact_groups(docs(rows))) == brute(rows)


def test_different_texts_under_one_digest_stay_apart(docs):
    rows = [(i, t) for i, t in enumerate(["a", "a ", "b", "b", "c", None, "", "dd", "d d"])]
    weak = dedup.exact_groups(docs(rows), digest=lambda text: F.length(text).cast("string"))
    found = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in weak.collect())
    assert found == [(0, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True),
                     (5, 5, 2, True), (6, 5, 2, False), (7, 8, 2, False), (8, 8, 2, True)]


def test_empty_table_and_clashing_columns(docs, spark):
    assert dedup.exact_groups(docs([])).collect() == []
    odd = docs([(1, "a"), (2, "a"), (3, "b")]).withColumns({c: F.lit(7) for c in ("digest", "best", "size", "rank", "kept", "_metadata")})
    left = dedup.exact_dedup(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_state_goes_on_across_runs(docs, spark):
    folder, checkpoint = scratch_path(spark, "in"), scratch_path(spark, "state")
    for rows in ([(2, "x"), (3, "y")], [(1, "x"), (4, "z")]):
        batch = dedup.arrivals(docs(rows))
        batch.write.mode("append").parquet(folder)
        dedup.remember(spark.readStream.schema(batch.schema).parquet(folder), checkpoint)
    state = dedup.remembered(spark, checkpoint).select("best.doc_id", "size").collect()
    assert sorted((r.doc_id, r["size"]) for r in state) == [(1, 2), (3, 1), (4, 1)]
