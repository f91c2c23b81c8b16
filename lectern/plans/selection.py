"""Queries on the question bank: who sees what, what a selection means, in which order questions come, and the sets put together from them.

Parts stand for questions: see ``BANK_SQL``. An event's answer goes to question k * 20 + user_id % 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators import access as P
from lectern.operators import analytics as A
from lectern.operators import ordered as O
from lectern.operators import relational as R
from lectern.plans.registry import EV_SQL as _EV
from lectern.plans.registry import NATURAL_SQL, ev, query
from lectern.sources.tables import table

BANK_SQL = """bank as (select p_partkey as id, p_name as stem, p_brand as sub_category,
    case p_type when 'PROMO' then null when 'STANDARD' then 'Paper 1' when 'MEDIUM' then 'Past papers' else 'Other' end as main_category,
    case when p_size % 7 = 0 then null else 'topic ' || (p_size % 5) end as topic, case when p_size % 3 = 0 then 'restricted' else 'open' end as access,
    case when p_size % 11 = 0 then 'private' when p_size % 13 = 0 then 'draft' else 'ready' end as status,
    case when p_size % 4 = 0 then p_size end as recall_group, p_size as size from part)"""
ANS_SQL = f"{_EV}, ans as (select event_id, user_id, ts, k * 20 + user_id % 20 as id, is_correct, confidence, event_type from ev)"
PAPERS_SQL = "papers as (select distinct l_partkey as id, year(o_orderdate) as year from lineitem join orders on l_orderkey = o_orderkey)"


def bank(spark, d) -> DataFrame:
    size = F.col("p_size")
    main = F.when(F.col("p_type") == "STANDARD", "Paper 1").when(F.col("p_type") == "MEDIUM", "Past papers").when(F.col("p_type") != "PROMO", "Other")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("stem"),
        F.col("p_brand").alias("sub_category"),
        main.alias("main_category"),
        F.when(size % 7 != 0, F.concat(F.lit("topic "), (size % 5).cast("string"))).alias("topic"),
        F.when(size % 3 == 0, "restricted").otherwise("open").alias("access"),
        F.when(size % 11 == 0, "private").when(size % 13 == 0, "draft").otherwise("ready").alias("status"),
        F.when(size % 4 == 0, size).alias("recall_group"),
        size.alias("size"),
    )


def ans(spark, d) -> DataFrame:
    return ev(spark, d).select("event_id", "user_id", "ts", (F.col("k") * 20 + F.col("user_id") % 20).alias("id"), "is_correct", "confidence", "event_type")


def papers(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("id", "year").distinct()


# Who sees what


@query(f"""with {BANK_SQL} select id, access <> 'restricted' and status <> 'private' as guest, status <> 'private' as student, true as admin from bank""")
def question_visibility(spark, d):
    role = lambda r: F.lit(r).cast("string")
    sees = lambda r, private: P.visible(F.col("access"), F.col("status"), P.sees_restricted(role(r)), F.lit(private))
    return bank(spark, d).select("id", sees(None, False).alias("guest"), sees("student", False).alias("student"), sees("admin", True).alias("admin"))


@query(f"""with {BANK_SQL} select id from bank where status = 'ready' and coalesce(main_category, '') not in ('Other') and coalesce(topic, '') not in ('topic 4')""")
def coalesced_not_in(spark, d):
    return bank(spark, d).filter((F.col("status") == "ready") & P.not_in_coalesced("main_category", ["Other"]) & P.not_in_coalesced("topic", ["topic 4"])).select("id")


@query(f"""with {BANK_SQL} select id from bank where size in (7, 11, 40) or coalesce(main_category in ('Paper 1', 'Past papers') and sub_category = 'Brand#5', false)""")
def subject_questions(spark, d):
    return bank(spark, d).filter(P.of_subject("Brand#5", [7, 11, 40], ["Paper 1", "Past papers"], book="size")).select("id")


@query(f"""with {BANK_SQL}, {PAPERS_SQL}, b as (select * from bank where main_category in ('Paper 1', 'Past papers'))
  select id from b where ((sub_category = 'Brand#1' and topic = 'topic 2') or sub_category in ('Brand#2', 'Brand#3'))
    and (main_category = 'Paper 1' or id in (select id from papers where year in (1996, 1999)))""")
def scoped_questions(spark, d):
    b = bank(spark, d)
    known = {f"Brand#{i}": [f"topic {t}" for t in range(5)] for i in range(1, 26)}
    scope = P.normal_scope({"sources": ["bank", "past", "none"], "subjects": ["Brand#1", "Brand#2", "Brand#3", "?"], "topics": ["Brand#1|topic 2", "Brand#9|topic 9"], "years": ["1996", 1999, "x"]}, known)
    tags = b.select("id", F.lit("subject").alias("axis"), F.col("sub_category").alias("label")).union(b.filter("topic is not null").select("id", F.lit("topic"), "topic"))
    return P.in_scope(b, tags, papers(spark, d), scope, {"bank": "Paper 1", "past": "Past papers"}).select("id")


@query(f"""with {BANK_SQL} select id, case when topic in ('topic 4') then case when contains(stem, 'ring') then 'Rings' when contains(stem, 'widget') then 'Widgets' end
    when coalesce(main_category, '') = 'Paper 1' or coalesce(main_category, '') like 'Past papers%' then coalesce(topic, case when contains(stem, 'ring') then 'Rings' when contains(stem, 'widget') then 'Widgets' end)
    else coalesce(case when contains(stem, 'ring') then 'Rings' when contains(stem, 'widget') then 'Widgets' end, null) end as subject from bank""")
def derived_subject(spark, d):
    s = P.subject_ladder(F.col("stem"), F.col("main_category"), F.col("topic"), {"ring": "Rings", "widget": "Widgets"}, ["topic 4"], ["Paper 1"], "Past papers")
    return bank(spark, d).select("id", s.alias("subject"))


# Predicates


@query("select o_orderkey from orders where o_orderpriority ilike '%urgent%'")
def substring_filter(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderpriority").ilike("%urgent%")).select("o_orderkey")


@query("select p_partkey from part where regexp_matches(lower(p_name), 'ring|bolt|gear')")
def word_pattern_filter(spark, d):
    return table(spark, d, "part").filter(F.lower("p_name").rlike("ring|bolt|gear")).select("p_partkey")


@query("select event_id from events where (user_id, event_type) in (select c_custkey, case when c_nationkey % 2 = 0 then 'click' else 'view' end from customer where c_acctbal > 5000)")
def tuple_in(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_nationkey") % 2 == 0, "click").otherwise("view").alias("event_type"))
    return table(spark, d, "events").join(c, ["user_id", "event_type"], "left_semi").select("event_id")


@query("""with e as (select event_id, case event_id % 4 when 0 then '["a","b"]' when 1 then '{"a":1}' when 2 then '[]' end as j from events)
  select event_id, case when json_type(j) = 'ARRAY' then json_array_length(j)::int end as n from e where case when json_type(j) = 'ARRAY' then json_array_length(j) > 0 else false end""")
def guarded_json_length(spark, d):
    j = F.when(F.col("event_id") % 4 == 0, '["a","b"]').when(F.col("event_id") % 4 == 1, '{"a":1}').when(F.col("event_id") % 4 == 2, "[]")
    # json_array_length is null for what isn't an array, so nothing depends on the order in which conditions run
    return table(spark, d, "events").select("event_id", F.json_array_length(j).alias("n")).filter("n > 0")


@query("""with p as (select l_orderkey, max(l_shipdate) as newest from lineitem group by 1), a as (select max(o_orderdate) as as_of from orders)
  select o_orderkey from orders left join p on l_orderkey = o_orderkey, a where o_orderstatus in ('P', 'O') and greatest(o_orderdate, o_orderdate + interval 1 day, coalesce(newest, o_orderdate)) < as_of - interval 60 minutes""")
def stale_books(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("P", "O"))
    newest = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("newest"))
    as_of = table(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of"))
    rows = o.join(newest, "o_orderkey", "left").join(F.broadcast(as_of))
    return rows.filter(P.stale(F.col("o_orderdate") + F.expr("interval 1 day"), F.col("o_orderdate"), F.col("newest"), F.col("as_of"))).select("o_orderkey")


@query("""with c as (select event_id, case when event_id % 5 > 0 then ts end as due from events where event_type = 'view'), a as (select min(ts) + interval 10 days as as_of from events)
  select event_id, due from c, a where due is null or due <= as_of order by due nulls first, event_id limit 500""")
def due_cards(spark, d):
    e = table(spark, d, "events")
    cards = e.filter("event_type = 'view'").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("due"))
    as_of = e.agg((F.min("ts") + F.expr("interval 10 days")).alias("as_of"))
    return P.due(cards.join(F.broadcast(as_of)), "due", F.col("as_of"), 500, "event_id").select("event_id", "due")


@query("""with q as (select l_orderkey as id, count(*) as n, count(*) filter (l_returnflag = 'R') as keys, count(*) filter (l_quantity < 3) as bare from lineitem group by 1)
  select id, case when id % 50 = 0 then 'no stem' when n not between 2 and 5 then n || ' options' when keys <> 1 then 'not exactly one key' when bare > 0 then 'empty option' end as reason from q""")
def question_validity(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("keys"), F.count_if(F.col("l_quantity") < 3).alias("bare"))
    stem = F.when(F.col("id") % 50 != 0, F.lit("stem"))
    return q.select("id", P.validity(stem, F.col("n"), F.col("keys"), F.col("bare")).alias("reason"))


@query("""with r as (select case when l_quantity < 8 then 'shape' when l_discount > 0.09 then 'answer changed' when l_tax > 0.07 then 'unsupported' end as reason from lineitem)
  select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1""")
def gate_ladder(spark, d):
    gates = {"shape": F.col("l_quantity") < 8, "answer changed": F.col("l_discount") > 0.09, "unsupported": F.col("l_tax") > 0.07}
    return P.gated(table(spark, d, "lineitem"), gates).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""select p_partkey, p_name, (select count(*) from part) as total from part order by p_name, p_partkey limit 50 offset 100""")
def bank_page(spark, d):
    return P.page(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 100, 50)


@query("""with t as (select p_partkey as id, case p_size % 3 when 0 then 'next-step' when 1 then 'reverse' else 'plain' end as kind, p_size % 2 = 0 as management, p_name ilike '%ring%' as reveals, p_partkey in (select l_partkey from lineitem where l_returnflag = 'R') as answered from part)
  select id, case when (kind = 'next-step' and management) or kind = 'reverse' or reveals then case when answered then 'retire' else 'delete' end end as fate from t""")
def variant_fate(spark, d):
    answered = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("answered")).distinct()
    t = table(spark, d, "part").join(answered, "p_partkey", "left")
    kind = F.when(F.col("p_size") % 3 == 0, "next-step").when(F.col("p_size") % 3 == 1, "reverse").otherwise("plain")
    return t.select(F.col("p_partkey").alias("id"), P.retirement(kind, F.col("p_size") % 2 == 0, F.col("p_name").ilike("%ring%"), F.coalesce("answered", F.lit(False))).alias("fate"))


@query("""with r as (select o_orderkey as id, case o_orderstatus when 'F' then 'supported' when 'O' then 'contradicted' end as verdict, o_orderpriority as chapter from orders)
  select coalesce(verdict, 'unrefereed') as verdict, count(*) as n from r where chapter ilike '%h%' group by 1""")
def recall_browse(spark, d):
    verdict = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "contradicted")
    r = table(spark, d, "orders").filter(F.col("o_orderpriority").ilike("%h%")).select(F.coalesce(verdict, F.lit("unrefereed")).alias("verdict"))
    return r.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select c_name as name, case c_nationkey % 3 when 0 then 'ready' when 1 then 'failed' else 'processing' end as status, c_custkey % 4 as children from customer where c_custkey % 5 <> 0),
  a as (select c.c_name as name, case when status = 'ready' then case when children = 0 then 'RETRY(no-data)' else 'SKIP' end when status in ('failed', 'processing') then 'RETRY(incomplete)' else 'NEW' end as action from customer c left join s on s.name = c.c_name)
  select name, action, case when action like 'RETRY%' then 0 when action = 'NEW' then 1 else 2 end as turn from a""")
def job_plan(spark, d):
    c = table(spark, d, "customer")
    status = F.when(F.col("c_nationkey") % 3 == 0, "ready").when(F.col("c_nationkey") % 3 == 1, "failed").otherwise("processing")
    state = c.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("name"), status.alias("status"), (F.col("c_custkey") % 4).alias("children"))
    return P.planned_jobs(c.select(F.col("c_name").alias("name")), state, verify=True)


@query("""with a as (select max(o_orderdate) - interval 400 days as as_of from orders) select o_orderkey from orders, a where o_orderkey % 7 < 4 and (o_orderstatus = 'P' or o_orderdate > as_of)""")
def unexpired_invites(spark, d):
    o = table(spark, d, "orders")
    as_of = o.agg((F.max("o_orderdate") - F.expr("interval 400 days")).alias("as_of"))
    expires = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return o.join(F.broadcast(as_of)).filter(P.unexpired(F.col("o_orderkey") % 7, F.lit(4), expires, F.col("as_of"))).select("o_orderkey")


# Joins


@query("""select o_custkey, count(*) as answers, count(*) filter (l_returnflag <> 'R') as correct, count(distinct o_orderkey) as attempts from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1""")
def attempt_answers(spark, d):
    # one row an attempt first, so that the distinct count is a plain one
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("right"))
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    rows = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey").agg(F.sum("n").alias("answers"), F.sum("right").alias("correct"), F.count(F.lit(1)).alias("attempts"))


@query(f"""with {ANS_SQL}, {BANK_SQL}, {PAPERS_SQL}, g as (select distinct coalesce(recall_group, -id) as grp from ans join bank using (id))
  select year, count(*) as questions, count(g.grp) as answered from papers join bank using (id) left join g on g.grp = coalesce(recall_group, -id) group by 1""")
def paper_coverage(spark, d):
    b = bank(spark, d).select("id", F.coalesce(F.col("recall_group").cast("long"), -F.col("id")).alias("grp"))
    g = ans(spark, d).select("id").distinct().join(b, "id").select("grp", F.lit(1).alias("hit")).distinct()
    return papers(spark, d).join(b, "id").join(g, "grp", "left").groupBy("year").agg(F.count(F.lit(1)).alias("questions"), F.count("hit").alias("answered"))


@query(f"""with {BANK_SQL}, t as (select id, 'subject' as axis, sub_category as label from bank union all select id, 'topic', topic from bank where topic is not null)
  select s.label as subject, t2.label as topic, count(*) as n from bank join t s on s.id = bank.id and s.axis = 'subject' left join t t2 on t2.id = bank.id and t2.axis = 'topic' where status = 'ready' group by 1, 2""")
def tag_pairs(spark, d):
    b = bank(spark, d)
    tags = b.select("id", F.lit("subject").alias("axis"), F.col("sub_category").alias("label")).union(b.filter("topic is not null").select("id", F.lit("topic"), "topic"))
    s, t = tags.filter("axis = 'subject'").select("id", F.col("label").alias("subject")), tags.filter("axis = 'topic'").select("id", F.col("label").alias("topic"))
    return b.filter("status = 'ready'").select("id").join(s, "id").join(t, "id", "left").groupBy("subject", "topic").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {ANS_SQL}, {BANK_SQL}, a as (select id, bool_or(is_correct) as ok from ans group by 1),
  r as (select bank.id, sub_category, case when ok then 0 when a.id is null then 1 else 2 end as rank from bank left join a using (id) where status = 'ready')
  select sub_category, id, rank from (select *, row_number() over (partition by sub_category order by rank, md5('7:' || id), id) as n from r) where n <= 12""")
def hardening_seeds(spark, d):
    rows = P.with_answered(bank(spark, d).filter("status = 'ready'"), ans(spark, d).select("id", "is_correct"))
    rows = rows.withColumn("rank", P.answered_rank(F.col("ever_right")))
    n = F.row_number().over(Window.partitionBy("sub_category").orderBy("rank", O.hash_order("id"), "id"))
    return rows.withColumn("n", n).filter("n <= 12").select("sub_category", "id", "rank")


@query(f"""with {ANS_SQL}, {BANK_SQL}, s as (select distinct id from ans where user_id = 7), v as (select distinct id from ans where user_id in (8, 9))
  select id, case when id in (select id from s) then 2 when id in (select id from v) then 1 else 0 end as rank from bank""")
def unseen_first(spark, d):
    a = ans(spark, d)
    return P.seen_rank(bank(spark, d).select("id"), a.filter("user_id = 7").select("id"), a.filter("user_id in (8, 9)").select("id"))


@query("""select o_orderkey, count(l_orderkey) as children, arg_max(l_suppkey, l_shipdate::varchar || '/' || lpad((999999999 - l_suppkey)::varchar, 10, '0')) as latest from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def counted_children(spark, d):
    return R.counted_and_latest(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_shipdate", "l_suppkey")


@query("""select level, subject, topic from (values (1), (2), (3)) l(level), (values ('Anatomy'), ('Pathology')) s(subject), (values ('a'), ('b')) t(topic)""")
def job_grid(spark, d):
    return R.job_grid(spark, level=[1, 2, 3], subject=["Anatomy", "Pathology"], topic=["a", "b"]).withColumn("level", F.col("level").cast("int"))


@query(f"""with n as (select doc_id, coalesce(case when doc_id % 3 = 0 then 'ref' || doc_id end, 'sha1:' || sha1({NATURAL_SQL})) as key from documents)
  select doc_id, min(doc_id) over (partition by key) as first, count(*) over (partition by key) as n from n""")
def natural_key_join(spark, d):
    """Each document with the class of its natural key: the least document of it, and how many there are."""
    from lectern.sources import files

    n = table(spark, d, "documents").withColumn("ref", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ref"), F.col("doc_id").cast("string"))))
    n = n.select("doc_id", files.natural_key("ref", "text").alias("key"))
    return n.join(n.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "key").select("doc_id", "first", "n")


@query("""select l_orderkey, l_linenumber, p_name, p_brand from lineitem left join part on p_partkey = l_partkey""")
def chunk_with_book(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey", "left").drop("l_partkey")


@query("""with w as (select c_custkey, row_number() over (order by md5('7:' || c_custkey), c_custkey) as ord from customer where c_acctbal > 8000) select c_custkey, c_name, ord from customer join w using (c_custkey)""")
def fetched_in_order(spark, d):
    c = table(spark, d, "customer")
    # the caller's list: here a hashed order of a few rows; numbered in one task, as such a list is
    wanted = c.filter("c_acctbal > 8000").select("c_custkey", F.row_number().over(Window.orderBy(O.hash_order("c_custkey"), "c_custkey")).cast("long").alias("ord"))
    return R.fetched_in_order(c.select("c_custkey", "c_name"), wanted, "c_custkey")


@query("""select p_partkey as clash from part where p_partkey in (select o_orderkey from orders where o_orderstatus = 'P')""")
def id_clashes(spark, d):
    return R.id_clashes(table(spark, d, "part"), table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("p_partkey")), "p_partkey").select(F.col("p_partkey").alias("clash"))


# Aggregates


@query("select user_id, count(distinct event_type || ':' || strftime(ts, '%Y-%m-%d')) as sessions from events group by 1")
def session_count(spark, d):
    return ev(spark, d).groupBy("user_id", "session").count().groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query(f"""with {_EV}, u as (select user_id, count(*) as answered, count(*) filter (event_type = 'view' and k % 4 = 1) as due_week, 1 + user_id % 40 as days_left from ev group by 1)
  select user_id, case when days_left > 0 then least(80, greatest(15, ceil(greatest(0, 2000 - answered)::double / days_left) + ceil(due_week::double / 7)))::int end as target from u""")
def daily_target(spark, d):
    u = ev(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("answered"), F.count_if((F.col("event_type") == "view") & (F.col("k") % 4 == 1)).alias("due_week"))
    return u.select("user_id", A.daily_target(F.lit(2000), F.col("answered"), F.col("due_week"), 1 + F.col("user_id") % 40).alias("target"))


@query(f"""with {_EV} select user_id, subject, n, place from (select user_id, subject, count(*) as n, row_number() over (partition by user_id order by count(*) desc, subject) as place from ev where not is_correct and confidence = 'sure' group by 1, 2) where place <= 5""")
def top_misconceptions(spark, d):
    by = ev(spark, d).filter(~F.col("is_correct") & (F.col("confidence") == "sure")).groupBy("user_id", "subject").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "subject")).cast("long")).filter("place <= 5")


@query("""with r as (select case lower(o_orderpriority) when '1-urgent' then 'High' when '2-high' then 'High' else o_orderpriority end as chapter, o_orderstatus from orders)
  select chapter, count(*) as recalls, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as headlines, count(*) filter (o_orderstatus = 'P') as disputed, round(count(*)::double / sum(count(*)) over (), 4) as share from r group by 1""")
def recall_frequency(spark, d):
    o = table(spark, d, "orders")
    kind, verdict = F.when(F.col("o_orderstatus") == "F", "headline").otherwise("variant"), F.when(F.col("o_orderstatus") == "P", "contradicted").otherwise("supported")
    return A.frequency(o.select(F.col("o_orderpriority").alias("chapter"), kind.alias("kind"), verdict.alias("verdict")), {"1-urgent": "High", "2-high": "High"})


@query("""with t as (select o_custkey as user_id, o_orderkey as attempt_id, o_orderdate as "at", o_orderkey % 20 as score, 20 as total, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders)
  select user_id, attempt_id, "at", score, round(100.0::double * score / total, 1) as accuracy from t where n <= 15""")
def attempt_trend(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 20).alias("score"), F.lit(20).alias("total"))
    return A.attempt_trend(o).drop("total")


@query("""select o_custkey as user_id, coalesce(p_type, 'General') as category, count(*) as total, count(*) filter (l_returnflag <> 'R') as correct, round(100.0::double * count(*) filter (l_returnflag <> 'R') / count(*), 1) as accuracy
  from lineitem join orders on o_orderkey = l_orderkey left join part on p_partkey = l_partkey where o_orderstatus <> 'P' group by 1, 2""")
def category_accuracy(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(o, "l_orderkey").join(p, "l_partkey", "left")
    by = rows.groupBy("user_id", F.coalesce("category", F.lit("General")).alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") != "R").alias("correct"))
    return by.withColumn("accuracy", A.percent(F.col("correct"), F.col("total")))


@query("""select l_suppkey as quiz_set_id, count(*) as n, max(l_shipmode) as topic, max(l_linenumber) as difficulty, max(l_orderkey) as newest from (select *, l_linestatus || l_returnflag as l_shipmode from lineitem) where l_suppkey is not null group by 1""")
def set_history(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("quiz_set_id"), F.concat("l_linestatus", "l_returnflag").alias("topic"), F.col("l_linenumber").alias("difficulty"), F.col("l_orderkey").alias("id"))
    return A.set_history(rows)


@query("select source as book, count(distinct lang) as headings from documents where lang is not null group by 1")
def heading_counts(spark, d):
    return table(spark, d, "documents").filter("lang is not null").groupBy(F.col("source").alias("book")).agg(F.countDistinct("lang").alias("headings"))


@query("""with b as (select o_orderkey as id, o_totalprice > 200000 as hit from orders where o_orderkey % 3 <> 0), a as (select o_orderkey as id, o_totalprice > 150000 and o_orderstatus <> 'P' as hit from orders where o_orderkey % 4 <> 0)
  select count(*) as common, count(*) filter (b.hit) as before, count(*) filter (a.hit) as after, count(*) filter (a.hit and not b.hit) as gained, count(*) filter (b.hit and not a.hit) as lost from a join b using (id)""")
def runs_compared(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return A.compared(o.filter("id % 3 <> 0").select("id", (F.col("o_totalprice") > 200000).alias("hit")), o.filter("id % 4 <> 0").select("id", ((F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") != "P")).alias("hit")))


@query("""select item_id as query_id, round(1 - len(list_filter(f, lambda g: not (contains(' ' || lower(text) || ' ', g[1]) or contains(' ' || lower(text) || ' ', g[2]))))::double / 3, 6) as recall from (select *, [['an', 'xyzzy'], ['tion', 'q#'], ['zzz', 'yyy']] as f from benchmark)""")
def fact_recall(spark, d):
    facts = F.array(*[F.array(*map(F.lit, g)) for g in (["an", "xyzzy"], ["tion", "q#"], ["zzz", "yyy"])])
    return A.fact_recall(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", facts.alias("facts"))).select("query_id", F.round("recall", 6).alias("recall"))


@query("select o_custkey as id, max(o_totalprice) as score from orders group by 1")
def best_of_queries(spark, d):
    return A.best_of(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("score")), "id")


# Orders


@query("""with e as (select c_mktsegment, c_custkey, cast(round(c_acctbal / 1000) as int) as score from customer), r as (select *, rank() over (partition by c_mktsegment order by score desc) as rank, row_number() over (partition by c_mktsegment order by score desc, c_custkey) as place from e)
  select c_mktsegment, c_custkey, score, rank, place from r where place <= 10 or c_custkey % 100 = 42""")
def leaderboard_own(spark, d):
    e = table(spark, d, "customer").select("c_mktsegment", F.round(F.col("c_acctbal") / 1000).cast("int").alias("score"), "c_custkey")
    return O.leaderboard(e, "c_mktsegment", "score", "c_custkey", own=F.col("c_custkey") % 100 == 42).withColumn("rank", F.col("rank").cast("long")).withColumn("place", F.col("place").cast("long"))


@query("""with d as (select distinct user_id, ts::date as day from events where event_type in ('purchase', 'signup')), z as (select user_id, cast(day + 1 as date) as day from (select user_id, day, lead(day) over (partition by user_id order by day) as after from d) where after - day = 2 and user_id % 2 = 0),
  k as (select * from d union select * from z), i as (select user_id, day, day - row_number() over (partition by user_id order by day)::int as island from k), r as (select user_id, count(*) as run, max(day) as ends from i group by user_id, island)
  select user_id, max(run) as best, coalesce(max(run) filter (ends >= (select max(day) from k) - 1), 0) as current from r group by 1""")
def streaks_with_freezes(spark, d):
    days = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup")).select("user_id", F.to_date("ts").alias("day")).distinct()
    return O.streaks(days, O.freezes(days).filter("user_id % 2 = 0"))


@query(f"""with {BANK_SQL}, f as (select id, sub_category, row_number() over (partition by coalesce(recall_group, -id) order by md5('7:' || id), id) as r from bank where status = 'ready') select id, sub_category from f where r = 1 order by md5('7:' || id), id limit 200""")
def group_first_n(spark, d):
    b = bank(spark, d).filter("status = 'ready'")
    key = F.coalesce(F.col("recall_group").cast("long"), -F.col("id"))
    return O.distinct_by_group(b.select("id", "sub_category", "recall_group"), key, [O.hash_order("id"), "id"], 200).select("id", "sub_category")


@query("""select event_id, case when event_id % 6 > 0 then value end as score, case when event_id % 4 > 0 then ts end as time_ms from events order by case when event_id % 6 > 0 then value end desc nulls last, case when event_id % 4 > 0 then ts end asc nulls first, event_id limit 300""")
def nulls_sorted(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 6 > 0, F.col("value")).alias("score"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("time_ms"))
    return e.orderBy(F.desc_nulls_last("score"), F.asc_nulls_first("time_ms"), "event_id").limit(300)


@query(f"""with {BANK_SQL} select id, size % 3 as rank from bank order by size % 3, md5('7:' || id), id limit 300""")
def ranked_then_random(spark, d):
    return bank(spark, d).select("id", (F.col("size") % 3).alias("rank")).orderBy("rank", O.hash_order("id"), "id").limit(300)


@query(f"""with {BANK_SQL}, {PAPERS_SQL}, y as (select id, count(*) as years from papers group by 1 having count(*) >= 2), f as (select id, years, row_number() over (partition by coalesce(recall_group, -id) order by years desc, id) as r from y join bank using (id)) select id, years from f where r = 1""")
def most_asked_seeds(spark, d):
    y = papers(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("years")).filter("years >= 2").join(bank(spark, d).select("id", "recall_group"), "id")
    return O.first_of_group(y, F.coalesce(F.col("recall_group").cast("long"), -F.col("id")), F.desc("years"), "id").select("id", "years")


@query(f"""with {_EV}, c as (select user_id, k, count(*) filter (not is_correct) as lapses, (k % 4)::int as box, max(ts) as due from ev group by 1, 2) select user_id, k, lapses from (select *, row_number() over (partition by user_id order by lapses desc, box, due, k) as r from c) where r <= 10""")
def weakest_concepts(spark, d):
    c = ev(spark, d).groupBy("user_id", "k").agg(F.count_if(~F.col("is_correct")).alias("lapses"), F.max("ts").alias("due"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("lapses"), F.col("k") % 4, "due", "k"))
    return c.withColumn("r", r).filter("r <= 10").select("user_id", "k", "lapses")


@query(r"""with h as (select distinct trim(regexp_extract(text, '^[^\n.!?]*')) as name from documents), s as (select name, regexp_replace(name, '^\s*(?:\d+(?:\.\d+)*|\d+\s*[-–]\s*\d+|[A-Za-z])\s*[.):\-]?\s+', '') as body from h where length(name) >= 2),
  w as (select name, body, len(regexp_extract_all(body, '[A-Za-z][A-Za-z''-]{2,}')) as n from s)
  select name, (case when body <> name then 3 else 0 end + case when n >= 2 then 2 else 0 end + case when n >= 5 then 1 else 0 end + case when length(body) between 10 and 70 then 1 else 0 end - (length(name) - length(body)))::int as score from w""")
def heading_scores(spark, d):
    h = table(spark, d, "documents").select(F.trim(F.regexp_extract("text", r"^[^\n.!?]*", 0)).alias("name")).distinct().filter(F.length("name") >= 2)
    return h.select("name", T.heading_score(F.col("name")).alias("score"))


@query(f"""with {_EV}, t as (select subject, k, count(*) as n, count(*) filter (is_correct) as correct from ev group by 1, 2), b as (select distinct k // 10 as subject, k from ev),
  m as (select b.subject, b.k, coalesce(n, 0) as answered, round(100.0::double * correct / n, 1) as accuracy from b left join t using (subject, k))
  select subject, k, answered, case when answered between 1 and 3 then 0 when answered >= 4 and coalesce(accuracy, 0) < 75 then 1 when answered = 0 then 2 else 3 end as tier from m""")
def topic_attention(spark, d):
    e = ev(spark, d)
    t = e.groupBy("subject", "k").agg(F.count(F.lit(1)).alias("answered"), F.count_if("is_correct").alias("correct"))
    m = e.select("subject", "k").distinct().join(t, ["subject", "k"], "left").fillna(0, ["answered", "correct"])
    m = m.withColumn("accuracy", A.percent(F.col("correct"), F.col("answered")))
    return m.select("subject", "k", "answered", A.attention(m).alias("tier"))


@query("""with a as (select l_orderkey as id, list(l_suppkey order by l_linenumber, l_suppkey) as x from lineitem where l_linestatus = 'O' group by 1), b as (select l_orderkey as id, list(l_partkey % 100 order by l_linenumber, l_partkey % 100) as y from lineitem where l_linestatus = 'F' group by 1)
  select id, array_to_string((select list(v order by i) from (select v, min(i) as i from (select unnest(list_concat(coalesce(x, []), coalesce(y, []))) as v, generate_subscripts(list_concat(coalesce(x, []), coalesce(y, [])), 1) as i) group by v)), ',') as ids from a full join b using (id)""")
def ordered_union(spark, d):
    l = table(spark, d, "lineitem")
    pick = lambda status, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == status, F.struct("l_linenumber", F.col(c).alias("v"))))), lambda s: s["v"])
    l = l.withColumn("small", F.col("l_partkey") % 100)
    both = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_distinct(F.concat(pick("O", "l_suppkey"), pick("F", "small"))).alias("ids"))
    return both.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# Arrays and maps


@query("""select l_orderkey as id, unnest(list(l_suppkey order by l_suppkey)) as option from lineitem group by 1""")
def unnested_options(spark, d):
    j = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.collect_list("l_suppkey")).alias("options"))
    return j.select("id", F.explode(F.from_json("options", "array<bigint>")).alias("option"))


@query("""select o_orderkey as id, coalesce(n, 0) as options from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'N' group by 1) on l_orderkey = o_orderkey""")
def option_counts(spark, d):
    l = table(spark, d, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("options"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(l, "id", "left").select("id", F.coalesce(F.size("options"), F.lit(0)).cast("long").alias("options")).withColumn("options", F.greatest("options", F.lit(0)))


@query("""with g as (select l_orderkey as id, list(l_suppkey order by l_linenumber, l_suppkey) as x from lineitem group by 1)
  select id, array_to_string(list_filter(list_transform(x, lambda i: case when i % 5 = 0 then i + 1000 when i % 5 = 1 then null else i end), lambda i: i is not null), ',') as ids from g""")
def remapped_ids(spark, d):
    """Every fifth id has a new one, the ids after those were dropped."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"]).alias("x"))
    old = F.filter("x", lambda i: i % 5 <= 1)
    moved = F.array_distinct(F.filter("x", lambda i: i % 5 == 0))
    mapping = F.map_from_arrays(moved, F.transform(moved, lambda i: i + 1000))
    return g.select("id", F.array_join(F.transform(R.remapped_ids(F.col("x"), mapping, old), lambda i: i.cast("string")), ",").alias("ids"))


@query("""with q as (select p_partkey as id, p_size % 6 as n, chr((97 + p_size % 7)::int) as key from part)
  select id, case when n >= 4 and (ascii(upper(key)) - 65) < n then upper(key) end as key, case when n >= 4 and (ascii(upper(key)) - 65) < n then n end as options from q""")
def normal_options(spark, d):
    letters = "abcdef"
    entries = F.array(*[F.struct(F.lit(f" {c} ").alias("k"), F.when(F.col("p_size") % 6 > i, F.lit(f" text {c}")).otherwise(" ").alias("v")) for i, c in enumerate(letters)])
    options, key = R.normal_options(F.map_from_entries(entries), F.substring(F.lit("abcdefg"), F.col("p_size") % 7 + 1, F.lit(1)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), key.alias("key"), F.when(options.isNotNull(), F.cardinality(options)).alias("options"))


@query("""with o as (select p_partkey as id, p_name as stem, unnest(['red ' || p_brand, 'blue ' || p_type, 'green', case when p_size % 10 = 0 then 'all of these' else 'grey ' || p_size end]) as o, unnest([0, 1, 2, 3]) as i, p_size % 4 as correct, p_size % 10 = 0 as stays from part),
  s as (select id, i, correct, stays, row_number() over (partition by id order by case when stays then lpad(i::varchar, 2, '0') else md5(stem || '|' || o) end, i) - 1 as place from o)
  select id, array_to_string(list(i order by place), ',') as ord, any_value(p) as key from (select s.*, (select place from s t where t.id = s.id and t.i = s.correct) as p from s) group by 1""")
def dealt_options(spark, d):
    p = table(spark, d, "part")
    last = F.when(F.col("p_size") % 10 == 0, "all of these").otherwise(F.concat(F.lit("grey "), F.col("p_size").cast("string")))
    texts = F.array(F.concat(F.lit("red "), "p_brand"), F.concat(F.lit("blue "), "p_type"), F.lit("green"), last)
    options, key = R.dealt_options(F.col("p_name"), texts, F.col("p_size") % 4, F.lit(None).cast("string"))
    place = F.transform(options, lambda o: (F.array_position(texts, o) - 1).cast("string"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(place, ",").alias("ord"), key.alias("key"))


@query("""with b as (select p_size % 5 as key from part), a as (select case when p_size % 10 = 3 then p_size % 3 else p_size % 5 end as key from part)
  select key, coalesce(x, 0) as before, coalesce(y, 0) as after from (select key, count(*) as x from b group by 1) full join (select key, count(*) as y from a group by 1) using (key)""")
def key_spread(spark, d):
    p = table(spark, d, "part").select("p_size", (F.col("p_size") % 5).alias("key"))
    return R.key_spread(p, p.withColumn("key", F.when(F.col("p_size") % 10 == 3, F.col("p_size") % 3).otherwise(F.col("key"))))


# Dates and numbers


@query("""select o_orderkey, (date '1998-08-01' - o_orderdate::date)::int as days_left, (date '1998-08-01' - o_orderdate::date) between 0 and 7 as sprint from orders""")
def sprint_gate(spark, d):
    left = F.datediff(F.lit("1998-08-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", left.alias("days_left"), left.between(0, 7).alias("sprint"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then null when c_acctbal / 100 >= 85 then 1 when c_acctbal / 100 >= 70 then 2 when c_acctbal / 100 >= 55 then 3 when c_acctbal / 100 >= 35 then 4 else 5 end as difficulty from customer")
def crowd_difficulty(spark, d):
    from lectern.functions.scheduling import crowd_difficulty as level

    return table(spark, d, "customer").select("c_custkey", level(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") / 100)).alias("difficulty"))


@query("select l_orderkey, l_linenumber, l_partkey, round(date_diff('second', o_orderdate, l_shipdate) / 60.0::double, 1) as minutes from lineitem join orders on o_orderkey = l_orderkey")
def duration_minutes(spark, d):
    from lectern.functions.scheduling import minutes_between

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(o, "l_orderkey")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", minutes_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("minutes"))


# Sets put together


@query(f"""with {BANK_SQL}, b as (select id, sub_category, recall_group from bank where status = 'ready' and access = 'open'), o as (select *, row_number() over (partition by sub_category order by md5('7:' || id), id) as turn from b)
  select id, sub_category, turn from o where turn <= 100 order by turn, sub_category limit 100""")
def weekly_mock(spark, d):
    b = bank(spark, d).filter(P.visible(F.col("access"), F.col("status"), F.lit(False), F.lit(False)) & (F.col("status") == "ready")).select("id", "sub_category")
    return O.round_robin(b, "sub_category", [O.hash_order("id"), "id"], 100).withColumn("turn", F.col("turn").cast("long"))


@query(f"""with {BANK_SQL}, {PAPERS_SQL}, b as (select id, sub_category, recall_group from bank where status = 'ready' and id in (select id from papers where year in (1997, 1998)) and size % 10 <> 9),
  f as (select * from (select *, row_number() over (partition by coalesce(recall_group, -id) order by md5('7:' || id), id) as r from b) where r = 1), o as (select id, sub_category, row_number() over (partition by sub_category order by md5('7:' || id), id) as turn from f)
  select id, sub_category, turn from o where turn <= 60 order by turn, sub_category limit 60""")
def timed_paper(spark, d):
    b = bank(spark, d).filter("status = 'ready' and size % 10 <> 9").join(papers(spark, d).filter("year in (1997, 1998)"), "id", "left_semi")
    once = O.first_of_group(b.select("id", "sub_category", "recall_group"), F.coalesce(F.col("recall_group").cast("long"), -F.col("id")), O.hash_order("id"), "id").select("id", "sub_category")
    return O.round_robin(once, "sub_category", [O.hash_order("id"), "id"], 60).withColumn("turn", F.col("turn").cast("long"))


@query(f"""with {ANS_SQL}, {BANK_SQL}, b as (select id, recall_group, sub_category = 'Brand#4' as weak from bank where status = 'ready' and id not in (select id from ans where user_id = 11)),
  o as (select *, row_number() over (order by case when weak then 0 else 1 end, md5('7:' || id), id) as place from b), f as (select id, place from (select *, row_number() over (partition by coalesce(recall_group, -id) order by place) as r from o) where r = 1)
  select id from f order by place limit 30""")
def offline_pack(spark, d):
    """Unanswered questions of user 11, the weakest subject first, one version of each."""
    done = ans(spark, d).filter("user_id = 11").select("id").distinct()
    b = bank(spark, d).filter("status = 'ready'").join(done, "id", "left_anti").withColumn("tier", F.when(F.col("sub_category") == "Brand#4", 0).otherwise(1))
    key = F.coalesce(F.col("recall_group").cast("long"), -F.col("id"))
    return O.distinct_by_group(b.select("id", "recall_group", "tier"), key, ["tier", O.hash_order("id"), "id"], 30).select("id")


@query(f"""with {BANK_SQL}, {PAPERS_SQL}, y as (select id, count(*) as n from papers group by 1), k as (select bank.id, topic, coalesce(n, 0) as asked, row_number() over (partition by coalesce(recall_group, -bank.id) order by bank.id) as r from bank left join y using (id) where status = 'ready')
  select id, topic, asked from k where r = 1 order by asked desc, topic nulls last, id limit 100""")
def keys_list(spark, d):
    b = O.first_of_group(bank(spark, d).filter("status = 'ready'"), F.coalesce(F.col("recall_group").cast("long"), -F.col("id")), "id")
    y = papers(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return b.join(y, "id", "left").select("id", "topic", F.coalesce("n", F.lit(0)).alias("asked")).orderBy(F.desc("asked"), F.asc_nulls_last("topic"), "id").limit(100)


@query(f"""with {ANS_SQL}, {BANK_SQL} select user_id, id, n from (select user_id, id, count(*) as n, row_number() over (partition by user_id order by count(*) desc, max(ts) desc, id) as r from ans join bank using (id) where not is_correct and status = 'ready' group by 1, 2) where r <= 8""")
def chapter_gaps(spark, d):
    a = ans(spark, d).filter(~F.col("is_correct")).groupBy("user_id", "id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    a = a.join(bank(spark, d).filter("status = 'ready'").select("id"), "id", "left_semi")
    return a.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), F.desc("last"), "id"))).filter("r <= 8").select("user_id", "id", "n")


@query("""select o_custkey % 50 as duel, o_custkey as player, score, time_ms, row_number() over (partition by o_custkey % 50 order by score desc, time_ms nulls last, o_custkey) as place
  from (select o_custkey, count(*) filter (o_orderstatus = 'F') as score, case when o_custkey % 9 > 0 then min(o_totalprice) end as time_ms from orders group by 1)""")
def duel_ranking(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("player")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("score"), F.min("o_totalprice").alias("t"))
    p = p.select((F.col("player") % 50).alias("duel"), "player", "score", F.when(F.col("player") % 9 > 0, F.col("t")).alias("time_ms"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("duel").orderBy(F.desc("score"), F.asc_nulls_last("time_ms"), "player")).cast("long"))


@query(f"""with {ANS_SQL}, {BANK_SQL} select distinct user_id, size as concept from ans join bank using (id) where (not is_correct or confidence = 'guess') and not exists (select 1 from events e where e.user_id = ans.user_id and e.event_type = 'purchase' and e.event_id % 50 = bank.size)""")
def pending_reviews(spark, d):
    """Concepts missed or guessed that have no review yet."""
    a = ans(spark, d).filter(~F.col("is_correct") | (F.col("confidence") == "guess")).select("user_id", "id").distinct()
    have = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", (F.col("event_id") % 50).cast("int").alias("concept")).distinct()
    return a.join(bank(spark, d).select("id", F.col("size").alias("concept")), "id").select("user_id", "concept").distinct().join(have, ["user_id", "concept"], "left_anti")


@query(f"""with {BANK_SQL}, g as (select recall_group, count(*) as n, count(distinct sub_category) > 20 as conflict from bank where recall_group is not null group by 1) select id, n - 1 as versions, conflict from bank join g using (recall_group) where n > 1""")
def recall_badges(spark, d):
    b = bank(spark, d).filter("recall_group is not null").select("id", "recall_group", "sub_category")
    g = b.groupBy("recall_group").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("sub_category") > 20).alias("conflict")).filter("n > 1")
    return b.join(g, "recall_group").select("id", (F.col("n") - 1).alias("versions"), "conflict")


@query(f"""with {_EV}, w as (select user_id, k // 20 as subject, count(*) as total, count(*) filter (is_correct) as correct, min(ts) as began, max(ts) as ended from ev where event_type = 'purchase' group by 1, 2),
  u as (select user_id, sum(total) as total, sum(correct) as correct, min(began) as began, max(ended) as ended from w group by 1)
  select user_id, correct::bigint as score, total::bigint as total, round(correct::double / total, 3) as fraction, correct::double / total >= 0.75 as passed, round(date_diff('microsecond', began, ended) / 60000000.0::double, 1) as minutes from u""")
def mock_result(spark, d):
    e = ev(spark, d).filter("event_type = 'purchase'")
    u = e.groupBy("user_id").agg(F.count_if("is_correct").alias("score"), F.count(F.lit(1)).alias("total"), F.min("ts").alias("b"), F.max("ts").alias("e"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return u.select("user_id", "score", "total", F.round(F.col("score") / F.col("total"), 3).alias("fraction"), (F.col("score") / F.col("total") >= 0.75).alias("passed"), F.round((micros("e") - micros("b")) / 60e6, 1).alias("minutes"))


@query("""with m as (select conv_id, max(turn) as last from conversations group by 1) select conv_id, case when last <= 2 then 'today' when last = 3 then 'yesterday' else 'older' end as bucket from m""")
def conversation_buckets(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").cast("int").alias("last"))
    today = F.lit("2024-02-01").cast("date")
    return m.select("conv_id", T.auto_bucket(F.date_sub(today, F.greatest(F.col("last") - 2, F.lit(0))), today).alias("bucket"))


@query("""select lang, count(*) as books, sum(n_chars)::bigint as pages, array_to_string(list(distinct source order by source), ',') as titles from documents group by 1""")
def library_groups(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("books"), F.sum("n_chars").alias("pages"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("titles"))


@query("""with q as (select event_id, user_id, event_type, value, row_number() over (partition by user_id, event_type order by event_id) as r from events), s as (select user_id, event_type from events where event_id % 3 = 0)
  select user_id, event_type, value from q where r = 1 and (user_id, event_type) not in (select user_id, event_type from s where event_type = 'view')""")
def offline_queue(spark, d):
    """Waiting answers of a device, one a pack and question, that the server hasn't had."""
    e = table(spark, d, "events")
    server = e.filter("event_id % 3 = 0 and event_type = 'view'").select("user_id", "event_type").distinct()
    first = O.first_of_group(e.select("event_id", "user_id", "event_type", "value"), F.struct("user_id", "event_type"), "event_id")
    return first.join(server, ["user_id", "event_type"], "left_anti").select("user_id", "event_type", "value")


@query(f"""with {ANS_SQL}, {BANK_SQL}, a as (select distinct id from ans) select sub_category, count(*) as n, count(a.id) as answered, round(100.0::double * count(a.id) / count(*), 1) as pct from bank left join a using (id) group by 1""")
def category_coverage(spark, d):
    a = ans(spark, d).select("id", F.lit(1).alias("hit")).distinct()
    by = bank(spark, d).join(a, "id", "left").groupBy("sub_category").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("answered"))
    return by.withColumn("pct", A.percent(F.col("answered"), F.col("n")))


_UNSEEN = f"""seen as (select distinct id from ans where user_id = 5), weak as (select sub_category from ans join bank using (id) where user_id = 5 group by 1 having count(*) >= 2 order by count(*) filter (is_correct)::double / count(*), sub_category limit 1),
  fresh as (select id, sub_category, recall_group, size from bank where status = 'ready' and access = 'open' and id not in (select id from seen))"""


def _unseen(spark, d):
    """(unseen open questions of user 5 with ``weak``: whether they are of the weakest subject, the user's answers)."""
    b, a = bank(spark, d), ans(spark, d).filter("user_id = 5")
    by = a.join(b.select("id", "sub_category"), "id").groupBy("sub_category").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("right")).filter("n >= 2")
    weak = by.orderBy(F.col("right") / F.col("n"), "sub_category").limit(1).select("sub_category", F.lit(True).alias("weak"))
    fresh = b.filter("status = 'ready' and access = 'open'").join(a.select("id").distinct(), "id", "left_anti").join(F.broadcast(weak), "sub_category", "left")
    return fresh.select("id", "sub_category", "recall_group", "size", F.coalesce("weak", F.lit(False)).alias("weak")), a


@query(f"""with {ANS_SQL}, {BANK_SQL}, {_UNSEEN}, due as (select size, max(ts) as at_ from ans join bank using (id) where user_id = 5 and not is_correct group by 1 order by at_, size limit 5),
  review as (select id, 'review' as kind from (select fresh.id, row_number() over (partition by size order by md5('7:' || fresh.id), fresh.id) as r from fresh join due using (size)) where r = 1),
  o as (select *, row_number() over (order by case when sub_category = (select sub_category from weak) then 0 else 1 end, md5('7:' || id), id) as place from fresh where id not in (select id from review)),
  n as (select id, 'new' as kind from (select id, place, row_number() over (partition by coalesce(recall_group, -id) order by place) as r from o) where r = 1 order by place limit 10) select * from review union all select * from n""")
def daily_dose(spark, d):
    """User 5's day: a new question on each of the five concepts longest missed, then ten new ones, the weakest subject first."""
    fresh, a = _unseen(spark, d)
    due = a.filter(~F.col("is_correct")).join(bank(spark, d).select("id", "size"), "id").groupBy("size").agg(F.max("ts").alias("at")).orderBy("at", "size").limit(5).select("size")
    review = O.first_of_group(fresh.join(F.broadcast(due), "size"), F.col("size"), O.hash_order("id"), "id").select("id", F.lit("review").alias("kind"))
    rest = fresh.join(review, "id", "left_anti").withColumn("tier", F.when(F.col("weak"), 0).otherwise(1))
    key = F.coalesce(F.col("recall_group").cast("long"), -F.col("id"))
    return review.unionByName(O.distinct_by_group(rest, key, ["tier", O.hash_order("id"), "id"], 10).select("id", F.lit("new").alias("kind")))


@query(f"""with {ANS_SQL}, {BANK_SQL}, {_UNSEEN}, c as (select size, count(*) filter (not is_correct) as lapses, count(*) filter (is_correct) as box, max(ts) as due from ans join bank using (id) where user_id = 5 group by 1 order by lapses desc, box, due, size limit 10),
  v as (select c.size, fresh.id, row_number() over (partition by c.size order by md5('7:' || fresh.id), fresh.id) as r from c left join fresh using (size)) select size as concept, id from v where r = 1""")
def sprint_set(spark, d):
    """User 5's ten weakest concepts, each with a new question where there is one."""
    fresh, a = _unseen(spark, d)
    c = a.join(bank(spark, d).select("id", "size"), "id").groupBy("size").agg(F.count_if(~F.col("is_correct")).alias("lapses"), F.count_if("is_correct").alias("box"), F.max("ts").alias("due"))
    c = c.orderBy(F.desc("lapses"), "box", "due", "size").limit(10).select("size")
    rows = F.broadcast(c).join(fresh.select("size", "id"), "size", "left")
    return O.first_of_group(rows, F.col("size"), O.hash_order("id"), "id").select(F.col("size").alias("concept"), "id")


@query(f"""with {ANS_SQL}, {BANK_SQL}, s as (select distinct id from ans where user_id = 7), v as (select distinct id from ans where user_id in (8, 9)),
  o as (select id, recall_group, row_number() over (order by case when id in (select id from s) then 2 when id in (select id from v) then 1 else 0 end, md5('7:' || id), id) as place from bank where status = 'ready' and main_category = 'Past papers')
  select id from (select id, place, row_number() over (partition by coalesce(recall_group, -id) order by place) as r from o) where r = 1 order by place limit 40""")
def quiz_start(spark, d):
    """A quiz of forty past-paper questions: new ones first, then those shown, then those answered; one version of each."""
    a = ans(spark, d)
    b = bank(spark, d).filter("status = 'ready' and main_category = 'Past papers'").select("id", "recall_group")
    ranked = P.seen_rank(b, a.filter("user_id = 7").select("id"), a.filter("user_id in (8, 9)").select("id"))
    return O.distinct_by_group(ranked, F.coalesce(F.col("recall_group").cast("long"), -F.col("id")), ["rank", O.hash_order("id"), "id"], 40).select("id")


@query(f"""with {ANS_SQL}, {BANK_SQL}, u as (select id, id % 500 as seed, sub_category from bank where main_category = 'Other' and status = 'ready' and id not in (select id from ans where user_id = 3)),
  f as (select * from (select *, row_number() over (partition by seed order by md5('7:' || id), id) as r from u) where r = 1), o as (select id, seed, sub_category, row_number() over (partition by sub_category order by md5('7:' || id), id) as turn from f)
  select id, seed from o where turn <= 30 order by turn, sub_category limit 30""")
def ready_made(spark, d):
    """Harder versions that user 3 hasn't met, one of each original, in turn over the subjects."""
    u = bank(spark, d).filter("main_category = 'Other' and status = 'ready'").join(ans(spark, d).filter("user_id = 3").select("id").distinct(), "id", "left_anti")
    once = O.first_of_group(u.select("id", (F.col("id") % 500).alias("seed"), "sub_category"), F.col("seed"), O.hash_order("id"), "id")
    return O.round_robin(once, "sub_category", [O.hash_order("id"), "id"], 30).select("id", "seed")


@query(f"""with {BANK_SQL}, {PAPERS_SQL}, y as (select recall_group, year from papers join bank using (id) where recall_group is not null),
  o as (select id, year from papers union select id, year from bank join y using (recall_group)) select id, array_to_string(list(distinct year order by year), ',') as years from o group by 1""")
def paper_years(spark, d):
    """The years in which each question, or another version of it, was asked."""
    b, p = bank(spark, d).select("id", "recall_group"), papers(spark, d)
    groups = p.join(b.filter("recall_group is not null"), "id").select("recall_group", "year").distinct()
    every = p.union(b.join(groups, "recall_group").select("id", "year")).distinct()
    return every.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("year")), lambda y: y.cast("string")), ",").alias("years"))


@query()
def recall_versions(spark, d):
    """Versions of a question in one group, a few dozen at most as in a bank, and whether their answers agree."""
    from lectern.operators import compare as C

    b = bank(spark, d).filter("recall_group is not null").select("id", F.struct("recall_group", F.floor(F.col("id") / 40)).alias("recall_group"), "stem")
    pairs = b.select("id", "recall_group", F.col("stem").alias("a")).join(b.select(F.col("id").alias("other"), "recall_group", F.col("stem").alias("b")), "recall_group").filter("id <> other")
    return C.agreement(pairs).select("id", "other", "agrees")
