"""Fill-in-the-middle against a plain version, piece sizes and edge cases."""

from __future__ import annotations

import hashlib
import pathlib
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))
from test_llm import table  # noqa: E402

from pitscape.llm import infill  # noqa: E402


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output, text) by the definition."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(3)
    alphabet = ["a", "Bc", "xyz", " ", "\n", "é", "😀", "<", ">", "<P", "S>", "7", "<M", "P"]
    rows = [(i - 60, "".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 2, 5, 40, 400]))), "a") for i in range(160)]
    rows += [(200, None, "a"), (201, "", "b"), (202, "a<P>b", "a"), (203, "q" * 3000 + "é" * 900, None), (204, "é1 " * 20_000, "a")]
    rows += [(-61, "repeated id", "a"), (-60, "repeated id", "a"), (None, "no id", "a"), (None, "no id either", "b")]
    return rows + [(300 + i % 2, "hot " * 50, "a") for i in range(400)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [4, 100, infill.PIECE])
def test_digests_match_the_definition(spark, size):
    rows = texts()
    want = sorted(((i, *(w := plain(i, t))[:4], digest(w[4]), digest(t or "")) for i, t, _ in rows), key=str)
    got = infill.digests(table(spark, rows).repartition(5), size)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_outputs_restore_to_the_texts(spark):
    rows = texts()
    out = infill.assembled(table(spark, rows), 64).withColumn("back", infill.restored(F.col("form"), F.col("output")))
    assert sorted(((r.doc_id, r.output) for r in out.collect()), key=str) == sorted(((i, plain(i, t)[4]) for i, t, _ in rows), key=str)
    assert sorted(r.back for r in out.collect()) == sorted(t or "" for _, t, _ in rows)


def test_hot_rows_stay_spread_and_counted(spark):
    docs = table(spark, [(5, "one text for all of them", "a")] * 3000).repartition(6)
    parts = infill.pieces(docs)
    assert parts.select("doc_id", "digest", "part").distinct().count() == 6
    assert parts.where("position = 0").agg(F.sum("times")).collect()[0][0] == 3000
    assert infill.digests(docs).count() == 3000


def test_empty_table(spark):
    assert infill.digests(table(spark, [])).collect() == [] and infill.assembled(table(spark, [])).collect() == []
