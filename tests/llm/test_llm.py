"""The operators for training data against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import pathlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))
import brute  # noqa: E402

from pitscape.llm import compression, licences, mixing, ngram_join, pii, quantised, reputation, suffixes, tiling, warc  # noqa: E402
from pitscape.llm.common import components  # noqa: E402

#: Extra columns with names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, size string, `group` string, token string"


def table(spark, rows):
    """documents with clashing extra columns; rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y", "z", "w") for i, t, s in rows], DOCS)


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    vocabulary = [word() for _ in range(300)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(40))
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 20, 60, 150])))
        kind = rnd.random()
        if rows and kind < 0.2:
            text = rnd.choice(rows)[1] or ""
        elif rows and kind < 0.5:
            w = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randint(1, 4)):
                if w:
                    w[rnd.randrange(len(w))] = word()
            text = " ".join(w)
        if rnd.random() < 0.4:
            text = text + " " + passage
        rows.append((i, text, rnd.choice(["a", "a", "a", "b", "c", None])))
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, "one two", None), (n + 3, "ONE  two\t", "é"), (n + 4, "long " * 5000, "a"), (n + 5, "é😀 " * 60, "b")]
    return rows


def test_components_follow_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_all_pairs(spark, seed):
    rows = corpus(seed)
    want = brute.groups([(i, t) for i, t, _ in rows])
    docs = table(spark, [*rows, rows[3], (None, "null id", "a")])
    got = ngram_join.similar_groups(docs).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted([*{c for _, c in want.values()}, None], key=str)


def test_prefix_bounds_hold():
    for n in range(1, 400):
        assert ngram_join.need(n) <= ngram_join.prefix_size(n) <= n


def test_repeated_bytes_match_brute_force(spark):
    rows = corpus(3, 60)
    want = brute.repeats([(i, t) for i, t, _ in rows])
    got = suffixes.deduplicated(table(spark, [*rows, (None, "loose", "a")])).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 0


def test_negative_ids_are_documents_like_others(spark):
    # ids as 64-bit hashes: half of them, and -1, are negative; over several partitions, so that copies meet in the exchange
    sign = lambda i: -1 if i == 7 else (i + 1) * 0x1E3779B97F4A7C15 % 2**64 - 2**63
    for rows in (corpus(3, 60), corpus(5, 60)):
        rows = [(sign(i), t, s) for i, t, s in rows]
        docs = table(spark, rows).repartition(8)
        want = brute.repeats([(i, t) for i, t, _ in sorted(rows)])
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicated(docs).collect()} == want


def test_long_texts_come_in_windows(spark, monkeypatch):
    # windows of 256 bytes: runs, slices and spans are cut by them, results are not
    rnd = random.Random(9)
    base = "".join(rnd.choice("abc d") for _ in range(3000))
    rows = [(4, base, "a"), (-3, base[500:1700] + "x" + base[1650:2500], "a"), (9, base[100:220] * 12 + "é" * 300, "b"), (2, "ab" * 900, "a")]
    want = brute.repeats([(i, t) for i, t, _ in sorted(rows)])
    packed = suffixes.packed_text(table(spark, rows)).toArrow().to_batches()
    monkeypatch.setattr(suffixes, "CHUNK", 256)
    entries = [b for b in suffixes._anchor_entries(1)(iter(packed))]
    first = [r for b in suffixes._resolve(False)(iter(entries)) for r in b.to_pylist()]
    opened = {i: [r["open"] for r in first if r["open"] and r["doc_id"] == i] for i, *_ in rows}
    texts = {r["doc_id"]: r["packed"] for b in packed for r in b.to_pylist()}
    look = [pa.RecordBatch.from_pylist([{"doc_id": i, "packed": texts[i], "open": opened[i]} for i in texts if opened[i]])]
    second = [r for b in suffixes._resolve(True)(suffixes._slice_entries(1)(iter(look))) for r in b.to_pylist()]
    window = [w for b in suffixes._explode_windows(iter([pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "windows": r["windows"]} for r in second if r["windows"]])])) for w in b.to_pylist()]
    lead = {}
    for w in window:
        lead[w["class"]] = min(lead.get(w["class"], (w["doc_id"], w["start"])), (w["doc_id"], w["start"]))
    late = {i: sorted({w["start"] for w in window if w["doc_id"] == i and lead[w["class"]] != (i, w["start"])}) for i in texts}
    whole = {i: [r["repeats"] for r in first + second if r["repeats"] and r["doc_id"] == i] for i in texts}
    last = pa.RecordBatch.from_pylist([{"doc_id": i, "packed": texts[i], "repeats": whole[i], "starts": late[i]} for i in texts])
    got = [r for b in suffixes._finish(iter([last])) for r in b.to_pylist()]
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_digests_alone_leave_the_kept_bytes_in_python(spark):
    # the digests need one Python process a task in the first step, and no kept text goes back to the JVM
    docs = table(spark, corpus(3, 60) + [(501, None, "a"), (502, "é" * 300, "a")])
    out = suffixes.deduplicated(docs, with_kept=False)
    assert "kept#" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r)[:5] for r in suffixes.deduplicated(docs).collect())
    raw = docs.select("doc_id", "text").toArrow().to_batches()
    packed = suffixes.packed_text(docs).toArrow().to_batches()
    entries = lambda batches: sorted((r["entries"] or b"") + (r["repeats"] or b"") for b in suffixes._anchor_entries(1)(iter(batches)) for r in b.to_pylist())
    assert entries(raw) == entries(packed)


def test_negative_ids_keep_their_prefix_tokens(spark):
    # near copies in groups of their own: only the exchange of the prefixes finds that they share tokens
    rows = [(i, " ".join(f"w{k % 40}{k // 2 + i // 2 * 50}" for k in range(80)) + f" end{i}", "a") for i in range(-8, 8)]
    docs = table(spark, rows).repartition(8)
    grouped = ngram_join.signatures(docs).select("doc_id", "n", F.col("doc_id").alias("group"), F.lit(1).cast("long").alias("members"))
    assert {r.doc_id for r in ngram_join.open_classes(docs, grouped).collect()} == set(range(-8, 8))


def test_base_spans_match_python_patterns(spark):
    texts = [
        "a@b.c_d@e.f x@y", "", None, "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.00004", "4111 1111 1111 1111-2 4111-1111-1111-1111 1 2 3", "+1 (22) 333-4444 +123 +12",
        "é😀 a@b.co 😀 +49 30 1234567", "1 " * 2000, "9" * 3000, "a.b@" * 200 + "x.y", "1.2.3.4." * 50, "+1" * 500,
    ]
    docs = table(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(1, "again a@b.cd", "a"), (None, "c@d.ef", "a")])
    for r in pii.private_spans(docs).collect():
        if r.doc_id not in (1, None):
            want = brute.base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert out[0] == "[EMAIL][EMAIL] x@y" and out[2] is None and out[6] == "é😀 [EMAIL] 😀 [PHONE]"


def test_boosted_candidates_add_spans(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        phone = f"({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
        rows.append((i, f"call +1 {phone} now" if i % 2 else f"ref {rnd.randint(10**8, 10**9)} end", "a"))
    rows.append((1000, "call 1 (555) 666-7777 now", "a"))
    got = {r.doc_id: r for r in pii.private_spans(table(spark, rows)).collect()}
    assert got[1000].spans == "phone:5:21" and got[1000].n_phone == 0
    assert got[0].spans == ""


def test_mix_meets_targets(spark):
    rows = corpus(7, 200)
    got = mixing.mixture(table(spark, [*rows, (None, "a b", "a")]))
    got = got.join(table(spark, rows).select("doc_id", "source"), "doc_id", "left").collect()
    want = brute.mix([(s, len(brute.words(t))) for _, t, s in rows] + [("a", 2)])
    for source, target in want.items():
        own = [r for r in got if r.doc_id is not None and r.source == source]
        assert own[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) + 2
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert mixing.mixture(table(spark, rows)).orderBy("doc_id").collect() == mixing.mixture(table(spark, rows).repartition(5)).orderBy("doc_id").collect()


def test_mix_keeps_columns_named_like_its_own(spark):
    rows = [(i, f"w{i} " * (1 + i % 7), "en", "ab"[i % 2], 5, "x", i, -i, "k", 9) for i in range(60)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, mix_key string, bar int, copies int, mix_h string, times int"
    docs = spark.createDataFrame(rows, shape)
    out = mixing.mixed_documents(docs)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mixture(docs).collect() if r.taken}
    assert out.columns == docs.columns
    assert {r.doc_id: r.times for r in out.collect()} == taken
    assert all((r.mix_key, r.bar, r.copies, r.mix_h) == ("x", r.doc_id, -r.doc_id, "k") for r in out.collect())


def test_archives_come_back(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(0, "http://a/", "<p>x</p>"), (1, None, None), (2, "http://b/WARC/1.1", ""), (3, "http://c/\r\nX: y", "<p>x</p>"), (4, "u", fake + "tail"), (5, "u", "é😀\r\n\r\n" + fake * 3), (6, "u", "z" * 300_000 + fake)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        assert got[page_id].payload_bytes == len((html or "").encode())
        assert got[page_id].record_type == ("revisit" if page_id in (2, 3) else "response")
        assert got[page_id].payload == (None if page_id in (2, 3) else html or "")
    assert (got[2].refers_to, got[3].refers_to) == (1, 0)
    import base64

    assert got[5].payload_digest == base64.b32encode(hashlib.sha1(rows[5][2].encode()).digest()).decode()


def test_tiles_match_brute_force(spark):
    rnd = random.Random(9)
    items = [(k, " ".join(rnd.choice("a b c d e f g h i j".split()) + str(rnd.randint(0, 9)) for _ in range(30))) for k in range(5)] + [(5, "short one here"), (6, None)]
    rows = []
    for i in range(30):
        w = (items[rnd.randrange(5)][1]).split()
        cut = rnd.randint(5, 25)
        rows.append((i, " ".join([*w[cut:], "filler, word", *w[: cut - rnd.randint(0, 4)]]).upper(), "a"))
    rows += [(30, "there is a Short one, here!", "a"), (31, None, "a"), (None, items[0][1], "a")]
    got = {(r.doc_id, r.item_id): r.covered for r in tiling.matches(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), coverage=0.0).collect()}
    for i, t, _ in rows[:30]:
        for k, x in items[:5]:
            assert got.get((i, k), 0) == brute.tiling(t.lower().replace(",", " ").split(), x.split(), 5)
    assert got[(30, 5)] == 3 and got[(None, 0)] == 30
    kept = tiling.decontaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {31, None} and 30 not in {r.doc_id for r in kept.collect()}


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 32))
    x = [*base, *(base[:30] + 0.15 * rng.standard_normal((30, 32))), *base[:5], 3 * base[7]]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [], 0), (904, [1.0, None], 0), (None, rows[0][1], 0)]
    got = quantised.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = (m @ m.T >= 0.9).sum(axis=1) - 1
    links = {r.vec_id: r.n_links for r in got}
    assert len(got) == len(rows) + len(odd) and all(links[i] <= want[i] for i in range(len(rows)))
    assert sum(links[i] for i in range(len(rows))) >= 0.9 * want.sum()
    assert all(links[i] == 0 for i in (900, 901, 902, 903, 904))


def test_vector_recall_at_every_length(spark, monkeypatch):
    """Planted pairs at cosine 0.91 among 36,500 vectors of four lengths; a family larger than a part of a bucket."""
    monkeypatch.setattr(quantised, "PART", 128)
    rnd = np.random.default_rng(3)
    rows, planted = [], []

    def put(v):
        rows.append((len(rows), v.tolist()))
        return len(rows) - 1

    for dims in (16, 32, 64):
        for v in rnd.standard_normal((8000, dims)):
            put(v)
        a = rnd.standard_normal((2000, dims))
        u = rnd.standard_normal((2000, dims))
        u -= (u * a).sum(axis=1, keepdims=True) / (a * a).sum(axis=1, keepdims=True) * a
        u *= np.linalg.norm(a, axis=1, keepdims=True) / np.linalg.norm(u, axis=1, keepdims=True)
        for x, y in zip(a, 0.91 * a + math.sqrt(1 - 0.91**2) * u, strict=True):
            planted.append((dims, put(x), put(y)))
    centre = rnd.standard_normal(48)
    family = [put(centre + 0.02 * rnd.standard_normal(48)) for _ in range(500)]
    got = {r.vec_id: r for r in quantised.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for dims in (16, 32, 64):
        pairs = [(a, b) for d, a, b in planted if d == dims]
        assert sum(got[a].component_id == got[b].component_id for a, b in pairs) >= 0.95 * len(pairs), dims
    assert all(got[i].component_id == family[0] for i in family)
    assert sum(got[i].n_links for i in family) >= 0.99 * 500 * 499
    assert not any(got[i].n_links for i in range(24_000, 32_000)), "unrelated vectors of 64 dimensions"


def test_pairs_at_the_bar_and_of_short_vectors(spark):
    """A cosine of exactly 0.9 links, just below does not; vectors of one and two components have codes of their own."""
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [9.0, 3.0, 3.0, 1.0]), (2, [2.0]), (3, [5.0]), (4, [-5.0]), (5, [8.99, 3.0, 3.0, 1.04]), (6, [0.0, 1.0]), (7, [0.3, 1.0])]
    vectors = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    want = {i: sum(j != i and len(rows[j][1]) == len(rows[i][1]) and float(vectors[i] @ vectors[j]) >= 0.9 for j in range(len(rows))) for i in range(len(rows))}
    got = {r.vec_id: r.n_links for r in quantised.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want


def test_scores_learn_quality(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "river", "stone", "walks", "quiet", "light", "under"]) for _ in range(60))
    bad = lambda: " ".join(rnd.choice(["buy", "###", "!!!", "cheap", "$$$"]) + rnd.choice("!#$") for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "a") for i in range(300)] + [(1000, None, "a"), (1001, "", "a")]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(300)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in compression.quality_scores(table(spark, rows), labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert len(got) == 302 and sum(got[i].predicted == bool(i % 3) for i in held) >= 0.95 * len(held)
    kept = compression.reject_low_quality(table(spark, rows), labels)
    assert kept.columns == table(spark, rows).columns
    none = compression.quality_scores(table(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_licence_sequences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    rows = [(0, "x\nLicensed under the Apache License, Version 2.0.\ny", "a"), (1, mit, "a"), (2, mit.split(". ")[1] + ". nothing else", "a"), (3, None, "a"), (4, "the license plate", "a"), (5, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "a")]
    got = {r.doc_id: (r.licences, r.unmatched) for r in licences.licence_scan(table(spark, rows)).collect()}
    assert got == {0: (["Apache-2.0"], ""), 1: (["MIT"], ""), 2: ([], "MITNOTICE"), 5: (["CC-BY-NC-4.0", "MIT-reference"], "")}


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{name}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """# Copyright 2020 Jane Doe
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
GPL3 = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */
int main;
"""
GPL2 = GPL3.replace("free software:", "free software;").replace("version 3", "version 2").replace("program.  If not", "program; if not")


def test_verbatim_wrapped_licences(spark):
    texts = [MIT, BSD.replace("{name}", ""), BSD.replace("{name}", BSD_NAME), APACHE, GPL3, GPL2, "Some words before\n" + MIT.replace("\n", "\r\n"), "Licensed under the\nApache License, Version 2.0.", "It was licensed under the Apache License, Version 2.0, once"]
    got = {r.doc_id: (r.licences, r.matches, r.unmatched) for r in licences.licence_scan(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    want = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0", "MIT", "Apache-2.0"]
    assert got == {i: ([name], 1, "") for i, name in enumerate(want)}


def test_host_rules_and_reputation(spark):
    urls = ["http://X.Net/a", "https://a.example.net/en/1?q#f", "a.example.com/de/", None, "http://example.com/de/x", "ftp://w.org/fr/", "http://net", "http://bad.io/1", "http://bad.io/2", "http://good.io/#x"]
    pages = spark.createDataFrame([(i, u, "", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 0, 1), (9, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judged(pages, labels).collect()}
    assert got[0] == ("x.net", "/a", "net/", "block") and got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("", "", None, "allow") == got[3] and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6][:3] == ("net", "", None) and got[7][3] == "block" and got[9][1] == "/"


def test_empty_tables(spark):
    docs = table(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        ngram_join.similar_groups(docs), mixing.mixture(docs), tiling.matches(docs, bench), licences.licence_scan(docs), pii.private_spans(docs), pii.redacted(docs),
        compression.quality_scores(docs, labels), suffixes.deduplicated(docs), mixing.mixed_documents(docs), ngram_join.one_of_each_group(docs),
        reputation.judged(spark.createDataFrame([], "page_id long, url string, html string"), labels),
        quantised.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0
