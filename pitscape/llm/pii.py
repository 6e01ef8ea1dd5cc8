"""Personal data by base patterns and boosted candidates, in SQL expressions alone.

Base spans (fixed patterns and checks) are always kept. Two generators with high recall propose further
spans, which may overlap base ones: runs of digits with any usual separators, and addresses with
written-out signs. Boosted trees score them by format and context; candidates of a bounded sample of texts that
overlap a base span are the positive examples, the others the negative ones, and features leave out what the base
patterns themselves test (the plus sign). The threshold is the lowest score at which the held-out half of the sample reaches
``precision``; candidates above it that touch no base span are added.

The fitted trees become one CASE expression, so that scoring is a pass over the texts without any
exchange. Patterns are written so that matching is linear in the text: runs start where the pattern's first
class begins (or where the last match ended) and repetitions give nothing back.

Defined cases: a null text counts as empty and has no spans; rows that repeat or have a null id are judged row by row; an empty table,
or one without candidates of both kinds, has no model and so base spans only. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import columns, saved

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base patterns, restated without backtracking; see the module.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+", "address": "", "digits": ""}
GENERATORS = {
    "address": r"(?<![\w.%+-])[\w.%+-]++\s?(?:@|\(at\)|\[at\])\s?[\w-]++(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]++)++",
    "digits": r"(?<![0-9])[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+",
}
FEATURES = ("digits", "letters", "spaces", "dots", "dashes", "brackets", "size", "luhn", "octets", "before", "after", "groups")


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(pattern: str, hint: str) -> str:
    """SQL: array of (s, e, m): matches with their places, from the pieces between them."""
    guard = f"contains(txt, {_sql(hint)})" if hint else "txt rlike '[0-9@]|[(\\\\[]at'"
    p = _sql(pattern)
    return f"""case when {guard} then aggregate(
        zip_with(regexp_extract_all(txt, {p}, 0), split(txt, {p}, -1), (m, g) -> named_struct('m', m, 'g', char_length(g))),
        named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)),
        (a, x) -> case when x.m is null then a else named_struct('at', a.at + x.g + char_length(x.m),
            'out', concat(a.out, array(named_struct('s', a.at + x.g, 'e', a.at + x.g + char_length(x.m), 'm', x.m)))) end,
        a -> a.out) else cast(array() as array<struct<s:int,e:int,m:string>>) end"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    """SQL: whether the digits of m pass Luhn's check."""
    return f"""aggregate(transform(split(reverse({_digits(m)}), '(?<=.)(?=.)'), (d, i) -> case when i % 2 = 0 then int(d)
        else int(d) * 2 - case when int(d) > 4 then 9 else 0 end end), 0, (a, d) -> a + d) % 10 = 0"""


def _between(m: str, low: int, high: int) -> str:
    return f"length({_digits(m)}) between {low} and {high}"


VALID = {
    "email": "true",
    "ip": f"x.m rlike {_sql(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}",
    "card": f"case when {_between('x.m', 13, 19)} then {_luhn('x.m')} else false end",
    "phone": _between("x.m", 9, 15),
}


def _features(m: str = "x.m", s: str = "x.s", e: str = "x.e") -> dict[str, str]:
    count = lambda chars: f"double(length({m}) - length(regexp_replace({m}, {_sql(chars)}, '')))"
    edge = lambda at: f"double(substring(txt, {at}, 1) rlike '[\\\\w]')"
    return {
        "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "spaces": count(r"\s"), "dots": count(r"[.]"), "dashes": count("[-/]"), "brackets": count(r"[()\[\]]"),
        "size": f"double(char_length({m}))",
        "luhn": f"double(case when {_between(m, 2, 40)} then {_luhn(m)} else false end)",
        "octets": f"double({m} rlike {_sql(f'^{OCTET}(?:[.]{OCTET}){{3}}$')})",
        "before": f"case when {s} = 0 then 0D else {edge(s)} end", "after": edge(f"{e} + 1"),
        "groups": f"double(size(split({m}, '[^0-9]+')))",
    }


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``txt``) and an array of valid spans (s, e, m) per base kind."""
    raw = docs.withColumns({k: F.expr(_spans(p, HINT[k])) for k, p in BASE.items()})
    return raw.withColumns({k: F.expr(f"filter({k}, x -> {VALID[k]})") for k in BASE})


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``candidates``: spans of the generators with their features and whether a base span is touched."""
    every = "concat(" + ", ".join(BASE) + ")"
    features = ", ".join(f"'{n}', {x}" for n, x in _features().items())
    made = [
        f"transform({_spans(p, HINT[g])}, x -> named_struct('kind', '{g}', 's', x.s, 'e', x.e, {features}, 'touches', exists(base, b -> b.s < x.e and x.s < b.e)))"
        for g, p in GENERATORS.items()
    ]
    return docs.withColumn("base", F.expr(every)).withColumn("candidates", F.expr(f"concat({', '.join(made)})"))


def _tree(lines: list[str]) -> str:
    """SQL of one tree from its description, which lists If/Else pairs depth first."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return line.split(":")[1].strip() + "D"
    feature, bar = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)
    return f"case when x.{FEATURES[int(feature)]} <= {bar}D then {low} else {_tree(lines)} end"


def fit(docs: DataFrame, sample_rows: int = 20_000, trees: int = 10, depth: int = 3, precision: float = 0.99) -> tuple[str, float] | None:
    """SQL of the score of candidate ``x`` and the threshold, from the candidates of at most ``sample_rows`` texts."""
    order = F.xxhash64("doc_id")
    ids = columns(docs, "doc_id").where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(sample_rows)
    texts = columns(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("txt"))  # at most sample_rows ids
    rows = with_candidates(with_base(texts)).select("doc_id", F.explode("candidates").alias("x")).select("doc_id", "x.*")
    rows = saved(rows.withColumns({"label": F.col("touches").cast("double"), "fold": F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))}).drop("doc_id", "s", "e"))
    kinds = {(r["label"], r["fold"]) for r in rows.select("label", "fold").distinct().collect()}  # four at most
    if len(kinds) < 4:
        return None
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.where("fold = 0")).select("features", "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, checkpointInterval=-1).fit(train.coalesce(1).sortWithinPartitions(F.hash("features"), "label"))
    parts = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [x for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        parts.append(f"{weight!r}D * ({_tree(lines)})")
    score = "1D / (1D + exp(-2D * (" + " + ".join(parts) + ")))"
    held = rows.where("fold = 1").select(F.struct(*FEATURES).alias("x"), "label").select(F.round(F.expr(score), 3).alias("p"), "label")
    steps = held.groupBy("p").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("p")).collect()  # 1001 rows at most
    good = n = 0.0
    bar = 2.0
    for step in steps:
        good, n = good + step["good"], n + step["n"]
        if good >= precision * n:
            bar = step["p"]
    return score, bar


def with_spans(docs: DataFrame, model: tuple[str, float] | None) -> DataFrame:
    """``docs`` (with ``txt``) and, per base kind, base spans in a column of its name and all spans in ``all_<kind>``."""
    found = with_base(docs)
    if model is None:
        return found.withColumns({f"all_{k}": F.expr(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e))") for k in BASE})
    score, bar = model
    found = with_candidates(found).withColumn("added", F.expr(f"filter(candidates, x -> not x.touches and round({score}, 3) >= {bar}D)"))
    kind = "case when x.kind = 'address' then 'email' when x.octets = 1 then 'ip' when x.digits >= 13 then 'card' else 'phone' end"
    both = "array_sort(concat(transform({k}, x -> named_struct('s', x.s, 'e', x.e)), transform(filter(added, x -> {kind} = '{k}'), x -> named_struct('s', x.s, 'e', x.e))))"
    return found.withColumns({f"all_{k}": F.expr(both.format(k=k, kind=kind)) for k in BASE})


def _listed(prefix: str = "") -> Column:
    """kind:start:end of all spans, by kind as listed, then start."""
    each = [F.expr(f"transform({prefix}{k}, x -> concat('{k}:', x.s, ':', x.e))") for k in BASE]
    return F.array_join(F.concat(*each), ",")


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans (all of them) of every row."""
    model = fit(docs)
    found = with_spans(columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("txt")), model)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed().cast("binary"), 256).alias("base_sha256"),
        _listed("all_").alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows the text if it is a long column."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index('text')}"
    found = with_spans(plain.withColumn("txt", F.coalesce(at, F.lit(""))), fit(docs))
    marks = "array_sort(concat(" + ", ".join(f"transform(all_{k}, x -> named_struct('s', x.s, 'e', x.e, 'k', '[{k.upper()}]'))" for k in BASE) + "))"
    # a span that begins inside the one before is swallowed by it
    cut = f"""aggregate({marks}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', greatest(a.at, x.e),
        'out', case when x.s >= a.at then concat(a.out, substring(txt, a.at + 1, x.s - a.at), x.k) else a.out end),
        a -> concat(a.out, substring(txt, a.at + 1)))"""
    touched = " + ".join(f"size(all_{k})" for k in BASE)
    text = F.when(F.expr(f"{touched} > 0"), F.expr(cut)).otherwise(F.col(at))
    out = found.withColumn(at, text)
    sized = [F.char_length(at).cast("long").alias(n) if n == "n_chars" and names.count(n) == 1 else F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    return out.select(*sized)
