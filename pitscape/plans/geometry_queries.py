"""Neighbours, densities, peer recall, archetypes, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pitscape.functions import ordering as O
from pitscape.functions import scalars as S
from pitscape.operators import archetypes as T
from pitscape.operators import components as C
from pitscape.operators import neighbours as X
from pitscape.operators import robust as R
from pitscape.plans.label_queries import CTES as LABEL
from pitscape.plans.label_queries import FEATURES, label_frame
from pitscape.plans.registry import query, r
from pitscape.plans.score_queries import report_components
from pitscape.session import cut, stored
from pitscape.sources import derived as D
from pitscape.sources.tables import scan

CTES = dict(LABEL)
LATENT = [f"latent_axis_{i}" for i in range(1, 7)]
_ALL = " and ".join(f"{c} is not null" for c in FEATURES)
_Z = ", ".join(f"({c} - avg({c}) over w)/case when stddev_pop({c}) over w > 0 then stddev_pop({c}) over w else 1 end z{i}" for i, c in enumerate(FEATURES))
_D2 = " + ".join(f"(a.z{i}-b.z{i})*(a.z{i}-b.z{i})" for i in range(6))


def _report_id():
    return S.composite_key("gvkey", "fyear")


CTES["lv0"] = """select *, gvkey||'|'||fyear id, count(*) over (partition by fyear, sic2) ni, count(*) over (partition by fyear) nd from comp"""
CTES["lv"] = """select *, case when ni >= 11 then 'sic2' when nd >= 11 and sic2 is not null then 'market' else 'unavailable' end lvl,
 case when ni >= 11 then fyear||'|'||sic2 else fyear||'|all' end g from lv0"""
CTES["cref"] = f"""select * from (select g, id, {', '.join(FEATURES)} from lv where lvl='sic2'
 union all select fyear||'|all', id, {', '.join(FEATURES)} from lv where fyear in (select fyear from lv where lvl='market')) where {_ALL}"""
CTES["czs"] = "select g, " + ", ".join(f"avg({c}) m{i}, stddev_pop({c}) s{i}" for i, c in enumerate(FEATURES)) + " from cref group by 1"
_SC = ", ".join(f"(x.{c}-s.m{i})/case when s.s{i} > 0 then s.s{i} else 1 end z{i}" for i, c in enumerate(FEATURES))
CTES["crz"] = f"select x.g, x.id, {_SC} from cref x join czs s on s.g=x.g"
CTES["cqz"] = f"select x.g, x.id, {_SC} from lv x join czs s on s.g=x.g where x.lvl <> 'unavailable' and " + " and ".join(f"x.{c} is not null" for c in FEATURES)
CTES["cd"] = f"""select g, id, case when count(*) = 10 then 1/(1+avg(d)) end density from (select a.g, a.id, sqrt({_D2}) d,
 row_number() over (partition by a.g, a.id order by {_D2}, b.id) rn from cqz a join crz b on a.g=b.g and a.id<>b.id) where rn <= 10 group by 1,2"""


@query(
    "nearest_embeddings",
    """select vec_id, peer, rank, round(dist,9) as distance from (select a.vec_id, b.vec_id peer, list_distance(a.embedding::double[], b.embedding::double[]) dist,
 row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), cast(b.vec_id as varchar)) as rank
 from embeddings a join embeddings b on a.label=b.label and a.vec_id<>b.vec_id) where rank <= 5""",
)
def nearest_embeddings(spark, d):
    rows = scan(spark, d, "embeddings", ["vec_id", "embedding", "label"]).select(
        F.col("label").cast("string").alias("g"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )
    out = X.nearest(rows, rows, 5, True)
    return out.select(F.col("id").cast("long").alias("vec_id"), F.col("peer").cast("long").alias("peer"), F.col("rank").cast("long").alias("rank"), r("distance", 9).alias("distance"))


@query(
    "nearest_embeddings_any_label",
    """select vec_id, peer, rank, round(dist,9) as distance from (select a.vec_id, b.vec_id peer, list_distance(a.embedding::double[], b.embedding::double[]) dist,
 row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), cast(b.vec_id as varchar)) as rank
 from embeddings a join embeddings b on a.vec_id<>b.vec_id) where rank <= 10""",
)
def nearest_embeddings_any_label(spark, d):
    rows = scan(spark, d, "embeddings", ["vec_id", "embedding"]).select(
        F.lit("all").alias("g"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )
    out = X.nearest(rows, rows, 10, True)
    return out.select(F.col("id").cast("long").alias("vec_id"), F.col("peer").cast("long").alias("peer"), F.col("rank").cast("long").alias("rank"), r("distance", 9).alias("distance"))


@query(
    "crowding_density",
    """select lv.gvkey, lv.fyear, lvl as level, case lvl when 'sic2' then ni when 'market' then nd else 0 end reference_count, round(density,8) density
 from lv left join cd on cd.id=lv.id and cd.g=lv.g""",
    CTES,
)
def crowding_density(spark, d):
    events = cut(report_components(spark, d).select("gvkey", "fyear", "sic2", *FEATURES))
    out = X.crowding(events, FEATURES, "fyear", "sic2", _report_id(), 10)
    return out.select(
        "gvkey", "fyear", F.col("crowding_level").alias("level"), F.col("crowding_reference_count").alias("reference_count"),
        r("crowding_density", 8).alias("density"),
    )


CTES["hev"] = "select *, gvkey||'|'||fyear id from lab"
CTES["hyr"] = "select distinct horizon_years, event_year y from hev"
CTES["href"] = """select e.horizon_years||'|'||y.y g, e.* from hev e join hyr y on y.horizon_years=e.horizon_years and e.event_year < y.y and year(e.label_observed_date) < y.y where e.y = 0"""
CTES["hn"] = "select g, count(*) n from href group by 1 having count(*) >= 100"
CTES["hzs"] = "select g, " + ", ".join(f"avg({c}) m{i}, stddev_pop({c}) s{i}" for i, c in enumerate(FEATURES)) + f" from href where {_ALL} and g in (select g from hn) group by 1"
CTES["hrz"] = f"select x.g, x.id, {_SC} from href x join hzs s on s.g=x.g where " + " and ".join(f"x.{c} is not null" for c in FEATURES)
CTES["hqz"] = f"select s.g, x.id, {_SC} from hev x join hzs s on s.g=x.horizon_years||'|'||x.event_year where " + " and ".join(f"x.{c} is not null" for c in FEATURES)
CTES["hd"] = f"""select g, id, case when count(*) = 20 then 1/(1+avg(d)) end density from (select a.g, a.id, sqrt({_D2}) d,
 row_number() over (partition by a.g, a.id order by {_D2}, b.id) rn from hqz a join hrz b on a.g=b.g) where rn <= 20 group by 1,2"""


@query(
    "success_density",
    """select e.gvkey, e.fyear, e.horizon_years, coalesce(n,0) reference_count, round(density,8) density from hev e
 left join hn on hn.g = e.horizon_years||'|'||e.event_year left join hd on hd.g = e.horizon_years||'|'||e.event_year and hd.id=e.id""",
    CTES,
)
def success_density(spark, d):
    labels = cut(label_frame(spark, d).select("gvkey", "fyear", "horizon_years", "feature_date", "failure_within_horizon", "label_observed_date", *FEATURES))
    out = X.success_density(labels.drop("failure_within_horizon", "label_observed_date"), labels, FEATURES, _report_id(), 20, 100)
    return out.select("gvkey", "fyear", "horizon_years", "reference_count", r("density", 8).alias("density"))


CTES["pj"] = f"""select c.gvkey, c.fyear, {', '.join('c.'+c for c in FEATURES)}, {', '.join(LATENT)} from comp c join truth t on t.gvkey=c.gvkey and t.fyear=c.fyear
 where {_ALL} and """ + " and ".join(f"{c} is not null" for c in LATENT)
CTES["po"] = f"select gvkey, fyear, {_Z} from pj window w as (partition by fyear)"
CTES["pl"] = "select gvkey, fyear, " + ", ".join(f"({c} - avg({c}) over w)/case when stddev_pop({c}) over w > 0 then stddev_pop({c}) over w else 1 end z{i}" for i, c in enumerate(LATENT)) + " from pj window w as (partition by fyear)"
for _n, _s in (("eo", "po"), ("el", "pl")):
    CTES[_n] = f"""select fyear, gvkey, peer, d, rn from (select a.fyear, a.gvkey, b.gvkey peer, sqrt({_D2}) d,
 row_number() over (partition by a.fyear, a.gvkey order by {_D2}, b.gvkey) rn from {_s} a join {_s} b on a.fyear=b.fyear and a.gvkey<>b.gvkey) where rn <= 20"""
CTES["precall"] = """select o.fyear, o.gvkey, coalesce(h.h,0)/20.0::double recall, 20.0::double/(n.n-1) random_recall, o.c oc, l.c lc from
 (select fyear, gvkey, -avg(d) c from eo group by 1,2) o join (select fyear, gvkey, -avg(d) c from el group by 1,2) l using (fyear, gvkey)
 left join (select fyear, gvkey, count(*) h from eo join el using (fyear, gvkey, peer) group by 1,2) h using (fyear, gvkey) join (select fyear, count(*) n from pj group by 1) n using (fyear)"""


#: Features, and what the truth of a report is made of.
REPORTED = ["gvkey", "datadate", "fyear", *FEATURES, "qty", "n_orders", "xsga", "sale", "ext_f", "capx", "at", "oiadp", "ppent"]


def peer_frames(spark, d):
    base = stored(C.accounting_components(D.reports(spark, d)).select(*REPORTED))  # both sides read it
    joined = base.select("gvkey", "datadate", "fyear", *FEATURES).join(D.report_truth(spark, d, base), ["gvkey", "datadate", "fyear"])
    rows = stored(joined.dropna(subset=[*FEATURES, *LATENT]))
    sizes = rows.groupBy(F.col("fyear").cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return rows, sizes


def recall_frame(spark, d):
    rows, sizes = peer_frames(spark, d)
    seen, true = stored(X.peer_edges(rows, "fyear", "gvkey", FEATURES, 20, lists=True)), X.peer_edges(rows, "fyear", "gvkey", LATENT, 20, lists=True)
    return stored(X.peer_recall(seen, true, sizes, 20))


@query("peer_edges", "select fyear, gvkey, peer, cast(rn as int) as rank, round(d,8) as distance from eo where rn <= 5", CTES)
def peer_edges(spark, d):
    """The five nearest peers of every report: the reported edge list."""
    rows, _ = peer_frames(spark, d)
    out = X.peer_edges(rows, "fyear", "gvkey", FEATURES, 5)
    return out.select(F.col("g").cast("int").alias("fyear"), F.col("id").alias("gvkey"), "peer", "rank", r("distance", 8).alias("distance"))


@query(
    "peer_recall",
    "select fyear, gvkey, round(recall,6) recall_at_k, round(random_recall,9) random_recall, round(oc,8) observed_crowding, round(lc,8) latent_crowding from precall",
    CTES,
)
def peer_recall(spark, d):
    return recall_frame(spark, d).select(
        F.col("g").cast("int").alias("fyear"), F.col("id").alias("gvkey"), r("recall_at_k").alias("recall_at_k"), r("random_recall", 9).alias("random_recall"),
        r("observed_crowding", 8).alias("observed_crowding"), r("latent_crowding", 8).alias("latent_crowding"),
    )


@query(
    "robust_scaled_features",
    "select gvkey, fyear, " + ", ".join(
        f"round(least(greatest((coalesce(c.{f}, s.m{i}) - s.m{i})/case when s.d{i}*1.4826::double > 1e-12 then s.d{i}*1.4826::double else 1 end,-8::double),8::double),7) {f}" for i, f in enumerate(FEATURES)
    ) + " from comp c cross join (select " + ", ".join(f"median({f}) m{i}, mad({f}) d{i}" for i, f in enumerate(FEATURES)) + " from comp where fyear <= 1998) s",
    CTES,
)
def robust_scaled_features(spark, d):
    base = cut(report_components(spark, d).select("gvkey", "fyear", *FEATURES))
    out = R.apply_robust_scale(base, R.fit_robust_scale(base.filter("fyear <= 1998"), FEATURES), FEATURES, 8.0)
    return out.select("gvkey", "fyear", *[r(c, 7).alias(c) for c in FEATURES])


@query(
    "cross_section_zscores",
    "select gvkey, fyear, " + ", ".join(f"round(z{i},7) {c}" for i, c in enumerate(FEATURES)) + " from (select gvkey, fyear, " + _Z + " from comp window w as (partition by fyear))",
    CTES,
)
def cross_section_zscores(spark, d):
    out = R.zscore_within(report_components(spark, d).select("gvkey", "fyear", *FEATURES), ["fyear"], FEATURES)
    return out.select("gvkey", "fyear", *[r(c, 7).alias(c) for c in FEATURES])


def _scaled_points(spark, d):
    base = cut(report_components(spark, d).select("gvkey", "fyear", *FEATURES))
    scaled = R.apply_robust_scale(base, R.fit_robust_scale(base.filter("fyear <= 1998"), FEATURES), FEATURES, 8.0)
    return cut(scaled.select("gvkey", "fyear", _report_id().alias("id"), F.array(*FEATURES).alias("v"), *FEATURES))


def _training(points):
    return points.filter("fyear <= 1998")


@query("archetype_assignments")
def archetype_assignments(spark, d):
    """Density archetypes fitted on all training reports, applied to every report."""
    points = _scaled_points(spark, d)
    _, clusters = T.density_clusters(_training(points), 10, 20)
    out = T.assignment_table(T.assign_by_search(points, clusters), 1998)
    return out.select("gvkey", "fyear", "archetype", "role", "is_noise", r("confidence").alias("confidence"))


@query("archetype_profiles")
def archetype_profiles(spark, d):
    points = _scaled_points(spark, d)
    _, clusters = T.density_clusters(_training(points), 10, 20)
    return T.profiles(cut(T.assignment_table(T.assign_by_search(points, clusters), 1998)), FEATURES)


@query("archetype_stability")
def archetype_stability(spark, d):
    points = _training(_scaled_points(spark, d))
    labels, _ = T.density_clusters(points, 10, 20)
    return T.cluster_stability(points, cut(labels), 10, 20)


@query(
    "radius_gated_assignment",
    """select * from (with c as (select label, [avg(embedding[i]::double) for i in range(1,65)] x from embeddings group by 1) select 1)""".replace(
        "with c as (select label, [avg(embedding[i]::double) for i in range(1,65)] x from embeddings group by 1) select 1",
        """with e as (select label, vec_id, unnest(embedding)::double x, generate_subscripts(embedding,1) i from embeddings),
 m as (select label, i, median(x) x from e group by 1,2), c as (select label, list(x order by i) c from m group by 1),
 dd as (select e.vec_id, c.label, e.label own, list_distance(e.embedding::double[], c.c) d from embeddings e cross join c),
 rr as (select label, greatest(quantile_cont(d, 0.95::double), 1e-9) r from dd where own=label group by 1),
 nn as (select *, row_number() over (partition by vec_id order by d, label) rn from dd)
 select vec_id, case when d <= r then nn.label else -1 end as label, round(case when d <= r then greatest(1-d/r,0) else 0 end,8) confidence, round(d,8) as distance
 from nn join rr on rr.label=nn.label where rn=1""",
    ),
)
def radius_gated_assignment(spark, d):
    """Median centroid and 95 % radius of each label, then gated nearest-centroid labels."""
    rows = cut(scan(spark, d, "embeddings", ["vec_id", "embedding", "label"]).select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v")))
    spread = rows.select("label", F.posexplode("v").alias("axis", "x"))
    mid = O.quantiles(spread, ["label", "axis"], "x", {"c": 0.5})
    centroid = mid.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "c"))), lambda s: s["c"]).alias("centroid"))
    placed = rows.join(centroid, "label").withColumn("d", T.distance("v", "centroid"))
    clusters = centroid.join(O.quantiles(placed, ["label"], "d", {"radius": 0.95}), "label").withColumn("radius", F.greatest("radius", F.lit(1e-9)))
    out = T.assign_nearest(rows.select("vec_id", "v"), clusters)
    return out.select("vec_id", "label", r("confidence", 8).alias("confidence"), r("distance", 8).alias("distance"))


def _label_clusters(rows):
    """Median centroid and 95 % radius of each label."""
    mid = O.quantiles(rows.select("label", F.posexplode("v").alias("axis", "x")), ["label", "axis"], "x", {"c": 0.5})
    centroid = mid.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "c"))), lambda s: s["c"]).alias("centroid"))
    placed = rows.join(centroid, "label").withColumn("d", T.distance("v", "centroid"))
    return centroid.join(O.quantiles(placed, ["label"], "d", {"radius": 0.95}), "label").withColumn("radius", F.greatest("radius", F.lit(1e-9)))


@query(
    "soft_membership",
    """select * from (with e as (select label, vec_id, unnest(embedding)::double x, generate_subscripts(embedding,1) i from embeddings),
 m as (select label, i, median(x) x from e group by 1,2), c as (select label, list(x order by i) c from m group by 1),
 dd as (select e.vec_id, c.label, e.label own, list_distance(e.embedding::double[], c.c) d from embeddings e cross join c),
 rr as (select label, greatest(quantile_cont(d, 0.95::double), 1e-9) r from dd where own=label group by 1),
 nn as (select vec_id, dd.label, d, r, greatest(1-d/r,0) w, row_number() over (partition by vec_id order by d, dd.label) rn from dd join rr on rr.label=dd.label qualify rn <= 3),
 ms as (select vec_id, max(case when rn=1 and d<=r then w else 0 end) mass, sum(w) tot from nn group by 1)
 select vec_id, label::int as label, round(case when mass > 0 then mass*w/tot else 0 end,8) probability from nn join ms using (vec_id)
 union all select vec_id, -1, round(1-mass,8) from ms)""",
)
def soft_membership(spark, d):
    """Shares of each vector in the labels of its three nearest centroids, and of noise (-1)."""
    rows = cut(scan(spark, d, "embeddings", ["vec_id", "embedding", "label"]).select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v")))
    out = T.soft_membership(rows.select("vec_id", F.col("vec_id").alias("id"), "v"), cut(_label_clusters(rows)), 3)
    noise = F.array(F.struct(F.lit(-1).alias("label"), F.col("noise_probability").alias("probability")))
    return out.select("vec_id", F.explode(F.concat("memberships", noise)).alias("m")).select("vec_id", "m.label", r("m.probability", 8).alias("probability"))


def _sourced(spark, d):
    points = _scaled_points(spark, d)
    labels, clusters = T.density_clusters(_training(points), 10, 20)
    return points, clusters, cut(T.sourced_assignments(points, cut(labels), clusters, 1998))


@query("sourced_assignments")
def sourced_assignments(spark, d):
    """Every report's archetype, from the fit itself or by the nearest centroid, with its share of noise."""
    _, _, out = _sourced(spark, d)
    return out.select("gvkey", "fyear", "archetype", "role", "used_to_fit", "assignment_source", "is_noise", r("confidence").alias("confidence"), r("noise_probability").alias("noise_probability"), F.size("memberships").alias("memberships"))


@query("archetype_gate")
def archetype_gate(spark, d):
    """Checks of the assignments and of the moves between them; the refits are counted by ``archetype_stability``."""
    points, clusters, out = _sourced(spark, d)
    order = W.partitionBy("gvkey").orderBy("fyear")  # reports of one firm, one a year
    moved = out.withColumns({"__from": F.concat_ws("|", "role", F.lag("archetype").over(order)), "__had": F.lag("archetype").over(order).isNotNull(), "__gap": F.col("fyear") - F.lag("fyear").over(order)})
    moves = T.transitions(moved.withColumn("__from", F.when(F.col("__had"), F.col("__from"))), "archetype", "__from", F.col("__gap"))
    return T.archetype_gate(points, out, clusters, 1998, moves)


@query(
    "state_transitions",
    """select from_state, to_state, count(*) n, round(count(*)/sum(count(*)) over (partition by from_state),9) probability, round(median(gap),6) median_gap, from_state=to_state persists
 from (select event_type to_state, lag(event_type) over w from_state, (epoch_us(ts)-epoch_us(lag(ts) over w))/1e6::double gap from events window w as (partition by user_id order by ts, event_id))
 where from_state is not null group by 1,2""",
)
def state_transitions(spark, d):
    """Event-type transitions per user; a hot user is cut into its hours."""
    events = scan(spark, d, "events", ["event_id", "ts", "user_id", "event_type"]).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    moves = O.with_previous(events, ["user_id"], ["us", "event_id"], ["us", "event_type"], F.floor(F.col("us") / 3_600_000_000))
    out = T.transitions(moves, "event_type", "previous_event_type", (F.col("us") - F.col("previous_us")) / 1e6)
    return out.select("from_state", "to_state", "n", r("probability", 9).alias("probability"), r("median_gap").alias("median_gap"), "persists")


@query("hashed_sample")
def hashed_sample(spark, d):
    """Seeded sample of 100 orders: a sampling operator."""
    return T.hashed_sample(scan(spark, d, "orders", ["o_orderkey", "o_custkey"]), "o_orderkey", 11, 100)


@query(
    "letter_labels",
    """select cast(l_orderkey % 60 as int) as idx, case when l_orderkey % 60 < 26 then chr(cast(65 + l_orderkey % 60 as int))
  else chr(cast(64 + floor((l_orderkey % 60)/26) as int)) || chr(cast(65 + (l_orderkey % 60) % 26 as int)) end as label, count(*) n from lineitem group by 1,2""",
)
def letter_labels(spark, d):
    idx = (F.col("l_orderkey") % 60).cast("int").alias("idx")
    counts = scan(spark, d, "lineitem", ["l_orderkey"]).groupBy(idx).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("idx", S.letter_label("idx").alias("label"), "n")
