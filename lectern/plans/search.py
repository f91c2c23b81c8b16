"""Queries on ranked passages and on vectors: what comes after fusion, and questions that repeat one another."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import vectors as V
from lectern.operators import analytics as A
from lectern.operators import cells as N
from lectern.operators import linkage as L
from lectern.operators import ordered as O
from lectern.operators import relational as R
from lectern.operators import retrieval as H
from lectern.plans.registry import query
from lectern.sources.tables import table

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2]::double))"
_PAIRS = f"p as (select a.vec_id as a, b.vec_id as b, a.label as la, b.label as lb, {_DOT} as cosine from embeddings a join embeddings b on a.vec_id < b.vec_id where {_DOT} >= 0.3)"
_R = """r as (select o_custkey as query_id, o_orderkey as parent, o_orderstatus as book, o_totalprice as score, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders)"""


def _pairs(spark, d, least: float = 0.3):
    e = table(spark, d, "embeddings")
    lab = e.select("vec_id", "label")
    rows = V.similar_pairs(e, least).join(lab.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a")
    return rows.join(lab.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")


def _ranked(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("parent"), F.col("o_orderstatus").alias("book"), F.col("o_totalprice").alias("score"))
    return R.dealt(r, "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "parent")))


# After fusion


@query("""with l as (select o_custkey as query_id, o_orderkey % 40 as parent, case when o_orderkey % 3 = 0 then 1 else 2 end as list_no, row_number() over (partition by o_custkey, o_orderkey % 3 = 0 order by o_totalprice desc, o_orderkey) as rank, o_orderkey as child from orders)
  select query_id, parent, child from l qualify row_number() over (partition by query_id, parent order by list_no, rank, child) = 1""")
def best_child(spark, d):
    o = table(spark, d, "orders")
    no = F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("query_id", "list_no").orderBy(F.desc("o_totalprice"), "child"))
    l = o.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 40).alias("parent"), no.alias("list_no"), F.col("o_orderkey").alias("child"), "o_totalprice")
    return H.best_child(l.withColumn("rank", rank))


@query(f"""with {_R}, s as (select *, (parent * 7919 % 1000)::double as second from r)
  select query_id, parent, row_number() over (partition by query_id order by case when rank <= 8 then 0 else 1 end, case when rank <= 8 then -second else rank end, rank) as rank from s""")
def second_stage(spark, d):
    r = _ranked(spark, d).withColumn("second", (F.col("parent") * 7919 % 1000).cast("double"))
    return H.reordered_head(r).select("query_id", "parent", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_R}, u as (select *, case when parent % 3 = 0 then 1 else 0 end as used from r), e as (select *, sum(1 - used) over (partition by query_id) >= 5 as enough from u)
  select query_id, parent, row_number() over (partition by query_id order by case when enough then used else 0 end, rank) as rank from e""")
def fresh_passages(spark, d):
    r = _ranked(spark, d)
    used = r.filter("parent % 3 = 0").select("query_id", "parent")
    return H.fresh_first(r, used, 5).select("query_id", "parent", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_R}, c as (select query_id, parent from r where book = 'F' and rank <= 12), p as (select r.query_id, r.parent, row_number() over (partition by r.query_id order by case when c.parent is null then 1 else 0 end, rank) as place from r left join c on c.query_id = r.query_id and c.parent = r.parent)
  select * from p where place <= 8""")
def sources_panel(spark, d):
    r = _ranked(spark, d)
    return H.sources_panel(r, r.filter("book = 'F' and rank <= 12")).withColumn("place", F.col("place").cast("long"))


@query(f"""with {_R}, h as (select * from r where rank <= 3), n as (select query_id, h.parent, h.rank, o.o_orderkey as id, o.o_orderkey - h.parent as away from h join orders x on x.o_orderkey = h.parent join orders o on o.o_orderkey between h.parent - 3 and h.parent + 3 and o.o_orderstatus = x.o_orderstatus)
  select query_id, parent, rank, id, away from n""")
def page_neighbours(spark, d):
    """Orders of a status as the passages of one book's page."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("book"), F.lit(1).alias("page"), F.col("o_orderpriority").alias("text"))
    return H.neighbours(_ranked(spark, d).filter("rank <= 3"), o).select("query_id", "parent", F.col("rank").cast("long").alias("rank"), "id", "away")


@query()
def context_blocks(spark, d):
    """Context blocks of each query's best three hits: greedy, so tests hold them against a plain loop."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("book"), F.lit(1).alias("page"), F.expr("repeat('x', cast(o_totalprice / 400 as int) + 1)").alias("text"))
    near = H.neighbours(_ranked(spark, d).filter("rank <= 3"), o)
    return H.expanded_blocks(near.withColumn("joins", (F.abs("away") == 1) | (F.col("id") % 2 == 0))).select("query_id", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("""with p as (select l_orderkey as query_id, l_suppkey as book, l_linenumber as page, l_partkey, case when l_partkey % 3 = 0 then 'as shown in Fig. ' || l_suppkey || '-' || l_linenumber || ' here' when l_partkey % 3 = 1 then 'Figure ' || l_suppkey || '.' || l_linenumber || ' A caption' else 'plain' end as text from lineitem),
  f as (select distinct query_id, book, page, book * 100 + page as id, ((book * 31 + page * 17 + query_id) % 100) / 100.0::double as sim from p), m as (select distinct query_id, book, page from p where l_partkey % 3 = 0),
  q as (select f.query_id, id, round(sim, 3) as relevance, m.query_id is not null as mentioned, sim from f left join m using (query_id, book, page) where (book + page) % 5 > 0)
  select query_id, id, relevance, mentioned, place from (select *, row_number() over (partition by query_id order by mentioned desc, relevance desc, id) as place from q where sim >= 0.6 or (mentioned and sim >= 0.5)) where place <= 4""")
def context_figures(spark, d):
    l = table(spark, d, "lineitem")
    n = [F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")]
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("as shown in Fig. "), n[0], F.lit("-"), n[1], F.lit(" here"))).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("Figure "), n[0], F.lit("."), n[1], F.lit(" A caption"))).otherwise("plain")
    pages = l.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("page"), text.alias("text"))
    pages = R.dealt(pages, "query_id")
    label = F.concat(F.lit("Figure "), F.col("book").cast("string"), F.lit("."), F.col("page").cast("string"))
    figures = pages.select("query_id", "book", "page").distinct().select(
        "query_id", "book", "page", (F.col("book") * 100 + F.col("page")).alias("id"), label.alias("label"), F.lit("printed").alias("caption_source"),
        ((F.col("book") + F.col("page")) % 5 == 0).alias("decorative"), (((F.col("book") * 31 + F.col("page") * 17 + F.col("query_id")) % 100) / 100.0).alias("sim"),
    )
    return H.chosen_figures(figures, pages).withColumn("place", F.col("place").cast("long"))


# Vectors


@query(f"""with q as (select * from embeddings where vec_id % 20 = 0), n as (select b.vec_id as query, a.vec_id as id, round({_DOT}, 4) as cosine, row_number() over (partition by b.vec_id order by round({_DOT}, 12) desc, a.vec_id) as rank from embeddings a, q b where a.label = b.label and a.vec_id % 3 > 0)
  select query, id, cosine, rank from n where rank <= 5""")
def filtered_vector_search(spark, d):
    """The five nearest child passages of the query's own chapter, for a stated set of queries."""
    e = table(spark, d, "embeddings")
    cells = N.write_cells(e.filter("vec_id % 3 > 0"), f"{R.scratch(spark)}/cells-{uuid.uuid4().hex}", group="label")
    found = N.nearest_in_cells(cells, e.filter("vec_id % 20 = 0"), 5, group="label").rows
    return found.select("query", "id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {_PAIRS} select a, b, round(cosine, 4) as cosine from p where cosine > 0.45 or (cosine > 0.38 and la = lb)""")
def pool_repeats(spark, d):
    p = _pairs(spark, d).withColumn("same_answer", F.col("la") == F.col("lb"))
    return L.pool_repeats(p, 0.45, 0.38).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query()
def kept_in_order(spark, d):
    """Vectors of each label, one request each, without those that repeat one kept before: tests hold the greedy order against a loop."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 7).alias("answer"), "label")
    return L.kept_in_order(e, "label", 0.4, 0.3).select("id", "label")


@query(f"""with {_PAIRS}, y as (select vec_id as id, [1990 + vec_id % 7, 2000 + vec_id % 5] as years from embeddings), b as (select a, b from p where cosine >= 0.35 union all select b, a from p where cosine >= 0.35),
  m as (select b.a as id, unnest(yb.years) as year from b join y ya on ya.id = b.a join y yb on yb.id = b.b where len(list_intersect(ya.years, yb.years)) = 0 union select id, unnest(years) from y)
  select id, array_to_string(list(distinct year order by year), ',') as years from m group by 1""")
def years_with_repeats(spark, d):
    y = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(1990 + F.col("vec_id") % 7, 2000 + F.col("vec_id") % 5).alias("years"))
    out = L.years_with_repeats(_pairs(spark, d), y, 0.35)
    return out.select("id", F.array_join(F.transform("years", lambda x: x.cast("string")), ",").alias("years"))


@query(f"""with {_PAIRS} select id, count(*) as times from (select vec_id as id from embeddings union all select a from p union all select b from p) group by 1""")
def times_asked(spark, d):
    return A.times_asked(_pairs(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


@query(f"""with c as (select * from embeddings where vec_id % 20 = 0), s as (select a.vec_id as card, b.vec_id as id, 0 as tier, md5('7:' || a.vec_id || ':' || b.vec_id) as o from c a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id and a.label % 2 = 0),
  n as (select a.vec_id as card, b.vec_id as id, 1 as tier, printf('%020.15f', 1 - round({_DOT}, 12)) as o from c a join embeddings b on a.vec_id <> b.vec_id where round({_DOT}, 12) >= 0.3 qualify row_number() over (partition by a.vec_id order by round({_DOT}, 12) desc, b.vec_id) <= 40)
  select card, id, tier from (select * from s union all select * from n) qualify row_number() over (partition by card order by tier, o, id) = 1""")
def variant_questions(spark, d):
    """A question of the card's concept where there is one (labels that are even), else the nearest of the 40 nearest."""
    e = table(spark, d, "embeddings")
    cards = e.filter("vec_id % 20 = 0")
    concepts = e.filter("label % 2 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("concept"))
    same = R.written(L.drawn(concepts.filter("id % 20 = 0").withColumnRenamed("id", "card"), concepts), "same-concept")
    rest = cards.join(same.select(F.col("card").alias("vec_id")), "vec_id", "left_anti")
    near = V.nearest(rest, e, 41).filter("query <> id").select(F.col("query").alias("card"), "id", "cosine")
    return L.variants(cards.select(F.col("vec_id").alias("card")), same, near, 0.3)


@query(f"""select a.vec_id as query, b.vec_id as id, round({_DOT}, 4) as cosine from embeddings a join embeddings b on a.vec_id % 20 = 0 qualify row_number() over (partition by a.vec_id order by round({_DOT}, 12) desc, b.vec_id) <= 40""")
def similar_existing(spark, d):
    e = table(spark, d, "embeddings")
    cells = N.write_cells(e, f"{R.scratch(spark)}/cells-{uuid.uuid4().hex}")
    return N.nearest_in_cells(cells, e.filter("vec_id % 20 = 0"), 40).rows.select("query", "id", F.round("cosine", 4).alias("cosine"))


@query(f"""with {_PAIRS}, o as (select a, b, cosine, case when a % 9 = 0 then 'All of them' else 'dose ' || a || ' mg' end as x, case when b % 4 = 0 then 'dose ' || b || ' mg' else 'drug ' || b end as y from p)
  select a, b, case when a % 5 = 0 then null when not regexp_matches(x, '(?i)^\\s*(all|none|both|neither)\\b') and trim(regexp_replace(regexp_replace(lower(x), '[\\d.,%/:+\\-−×]+', ' ', 'g'), '\\s+', ' ', 'g')) <> trim(regexp_replace(regexp_replace(lower(y), '[\\d.,%/:+\\-−×]+', ' ', 'g'), '\\s+', ' ', 'g')) and cosine >= 0.33 then 'confusion' when b % 2 = 0 then 'misconception' else 'gap' end as kind from o""")
def mistake_kinds(spark, d):
    x = F.when(F.col("a") % 9 == 0, "All of them").otherwise(F.concat(F.lit("dose "), F.col("a").cast("string"), F.lit(" mg")))
    y = F.when(F.col("b") % 4 == 0, F.concat(F.lit("dose "), F.col("b").cast("string"), F.lit(" mg"))).otherwise(F.concat(F.lit("drug "), F.col("b").cast("string")))
    kind = L.mistake(F.col("cosine"), x, y, F.col("a") % 5 == 0, F.when(F.col("b") % 2 == 0, "sure").otherwise("guess"), 0.33)
    return _pairs(spark, d).select("a", "b", kind.alias("kind"))


@query("""select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as dot, round(embedding[1]::double / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-9), 6) as first from embeddings""")
def unit_vectors(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(V.dot(v, v), 6).alias("dot"), F.round(V.unit(v)[0], 6).alias("first"))


@query()
def rising_pages(spark, d):
    """The longest rising chain of each user's values in order of time."""
    e = table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return O.rising(e, "user_id", "event_id", "v")
