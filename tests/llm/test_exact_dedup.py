import hashlib
import re

from pyspark.sql import functions as F

from panelwright.llm.exact_dedup import drop_exact_copies, exact_groups


def plain(rows):
    """Brute force over (id, text)."""
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = (
    [(i, "hot text") for i in range(100, 700)]
    + [(i, f"text  {i % 7}") for i in range(50)]
    + [(i, f"alone {i}") for i in range(1000, 1300)]
    + [(2000, None), (2001, ""), (2002, " "), (2003, "\t\n "), (2004, " "), (None, "hot text"), (None, "only null"), (None, "only null"), (7, "hot\ttext"), (7, "hot text"), (3000, "x" * 200_000), (3001, "x" * 200_000)]
)


def test_equals_brute_force_with_and_without_heavy_digests(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    for share in (1, 20, 1000):
        got = sorted((tuple(r) for r in exact_groups(docs, heavy_share=share).collect()), key=repr)
        assert got == plain(ROWS)


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_table_and_clashing_columns(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a", "k", 5), (2, "a", "l", 6), (3, "b", None, 7)], "doc_id long, text string, keep_id string, n int")
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert exact_groups(docs).where(F.col("kept")).count() == 2
