"""Queries on books, pages and texts: what a page is, what a text says, which references hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import books as B
from lectern.operators import compare as C
from lectern.operators import ordered as O
from lectern.operators import relational as R
from lectern.operators import retrieval as H
from lectern.plans.registry import query
from lectern.sources import files
from lectern.sources.tables import table

_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split(" + _NORM.format("text") + ", ' ')[1:80], lambda x: x <> ''))"

# Words and answers


@query(f"select conv_id, turn, md5({_NORM.format('text').replace('[^a-z0-9]+', '[^a-z0-9+-]+')}) as term_md5 from conversations")
def term_norm(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.term(F.col("text"))).alias("term_md5"))


_ANSWER = "case p_size % 6 when 0 then 'left ' when 1 then 'right ' when 2 then 'acute ' when 3 then 'chronic ' when 4 then 'hyper' else 'hypo' end || p_name || case when p_partkey % 3 = 0 then ' ' || p_partkey % 4 else '' end"


def _answers(spark, d):
    size = F.col("p_size") % 6
    side = F.when(size == 0, "left ").when(size == 1, "right ").when(size == 2, "acute ").when(size == 3, "chronic ").when(size == 4, "hyper").otherwise("hypo")
    number = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), (F.col("p_partkey") % 4).cast("string"))).otherwise("")
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(side, "p_name", number).alias("a"))
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")


@query(f"""with a as (select p_partkey as id, {_ANSWER} as a from part), p as (select x.id, x.a, y.a as b from a x join a y on y.id = x.id + 1),
  o as (select * from (values {', '.join(f"('{x}', '{y}')" for x, y in T.OPPOSED)}) t(x, y))
  select id, (len(regexp_extract_all(a, '\\d+')) > 0 and len(regexp_extract_all(b, '\\d+')) > 0 and regexp_extract_all(a, '\\d+') <> regexp_extract_all(b, '\\d+'))
    or exists (select 1 from o where (contains(a, x) and contains(b, y) and not contains(b, x)) or (contains(b, x) and contains(a, y) and not contains(a, x))) as opposed from p""")
def opposed_answers(spark, d):
    return _answers(spark, d).select("id", T.opposed(F.col("a"), F.col("b")).alias("opposed"))


@query()
def answer_agreement(spark, d):
    """Whether neighbouring answers name the same thing, and why: difflib's ratio has no SQL form, tests hold the stages."""
    return C.agreement(_answers(spark, d)).select("id", "stage", "agrees")


@query()
def text_repeats(spark, d):
    """Turns of a conversation that repeat one another."""
    c = table(spark, d, "conversations")
    pairs = c.select("conv_id", F.col("turn"), F.col("text").alias("a")).join(c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])
    return C.text_repeats(pairs).select("conv_id", "turn", "repeats")


def _us(s: str) -> str:
    out = f"lower({s})"
    for uk, us in T.UK_US:
        out = f"replace({out}, '{uk}', '{us}')"
    return out


_STEM = "case when regexp_matches(w, '^\\d') then w else w[1:6] end"


@query(f"""with a as (select item_id, list_filter(regexp_extract_all({_us('text')}, '\\d+(?:\\.\\d+)?|[a-z]{{3,}}'), lambda w: w not in ({', '.join(repr(w) for w in T.SUPPORT_STOP)})) as ws from benchmark),
  d as (select doc_id, {_us('text')} as body from documents),
  n as (select item_id, doc_id, len(ws) as n, len(list_filter(ws, lambda w: contains(body, {_STEM}) {' '.join(f"or (contains({_STEM}, '{g}') and contains(body, replace({_STEM}, '{g}', 'f')))" for g in T.LIGATURES)})) as k from a, d where len(ws) > 0)
  select item_id, doc_id, k::double / n as share from n where k::double / n >= 0.5 union all select item_id, null, 1.0::double from a where len(ws) = 0""")
def answers_supported(spark, d):
    """Every benchmark text against every document: those that have at least half of its key words."""
    return C.supported_by(table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer")), table(spark, d, "documents").select("doc_id", "text"))


@query(f"""with a as (select conv_id, turn, text as stem, list_filter(string_split({_NORM.format("array_to_string(string_split(text, ' ')[1:2], ' ')")}, ' '), lambda w: length(w) >= 3 and w not in ({', '.join(repr(w) for w in sorted(T.ANSWER_STOP))})) as ws from conversations)
  select conv_id, turn, coalesce(len(list_filter(ws, lambda w: length(w) >= 5 and w not in ({', '.join(repr(w) for w in sorted(T.GENERIC_ANSWER))}))) > 0, false)
    and len(list_filter(ws, lambda w: not list_contains(list_transform(string_split({_NORM.format('stem')}, ' '), lambda x: rtrim(x, 's')), rtrim(w, 's')))) = 0 as reveals from a""")
def revealing_stems(spark, d):
    answer = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    return table(spark, d, "conversations").select("conv_id", "turn", T.reveals(F.col("text"), answer).alias("reveals"))


@query("select conv_id, turn, length(text) > 120 or regexp_matches(lower(text), 'year old|year-old|presents|presented|complains|patient') as clinical from conversations")
def clinical_stems(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.clinical(F.col("text")).alias("clinical"))


#: An abbreviation that each pattern of the synonyms matches, to be asked in turn.
_ABBREVIATIONS = [p.replace("\\b", "").replace("?", "").strip("()").upper() for p in T.SYNONYMS]
_EDGE = r"[^\pL\pN_]"
_FOUND = ", ".join(f"case when regexp_matches(q, '(?i)(?:^|{_EDGE}){p.replace(chr(92) + 'b', '')}(?:$|{_EDGE})') then '{w}' end" for p, w in T.SYNONYMS.items())


@query(f"""with c as (select conv_id, turn, text || ' ' || ({_ABBREVIATIONS})[((conv_id + turn) % {len(_ABBREVIATIONS)})::int + 1] as q from conversations)
  select conv_id, turn, array_to_string([q] || list_filter([{_FOUND}], lambda x: x is not null), ' ') as query from c""")
def expanded_queries(spark, d):
    """Every turn as a query that ends in one of the known abbreviations."""
    asked = F.get(F.array(*map(F.lit, _ABBREVIATIONS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_ABBREVIATIONS))).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.expanded(F.concat("text", F.lit(" "), asked), T.SYNONYMS).alias("query"))


def _ways() -> str:
    ways = [w for us, uk in T.US_UK_FRAGMENTS for w in ((us, uk), (uk, us))] + [(g, "f") for g in T.LIGATURES]
    return ", ".join(f"('{x}', '{y}')" for x, y in ways)


@query(f"""with w as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from documents where lang = 'en'), x as (select * from (values {_ways()}) t(x, y))
  select word, array_to_string(list_sort(list(distinct replace(word, x, y))), ',') as others from w join x on contains(word, x) where replace(word, x, y) <> word group by 1""")
def spelling_variants(spark, d):
    w = B.word_counts(table(spark, d, "documents").filter("lang = 'en'")).select("word")
    return w.withColumn("others", T.spellings(F.col("word"))).filter(F.size("others") > 0).select("word", F.array_join("others", ",").alias("others"))


@query("select lower(w) as word, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents) group by 1")
def vocabulary(spark, d):
    return B.word_counts(table(spark, d, "documents"))


@query("""with t as (select doc_id, text, text[length(text) // 2:length(text) // 2 + 120] as child from documents), p as (select *, case when child <> '' then strpos(text, child[1:80]) else 0 end as at_ from t)
  select doc_id, md5(case when length(text) <= 1500 then text else text[case when at_ > 0 then greatest(at_ - 1 - 375, 0) else 0 end + 1:case when at_ > 0 then greatest(at_ - 1 - 375, 0) else 0 end + 1500] end) as m from p""")
def focus_windows(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    child = F.substring("text", F.greatest(half, F.lit(1)), F.when(half > 0, F.lit(121)).otherwise(120))
    return table(spark, d, "documents").select("doc_id", F.md5(T.focus(F.col("text"), child)).alias("m"))


@query("select conv_id, turn, starts_with(lower(trim(case when turn % 4 = 1 then '  The AI service did not respond in time' else text end)), 'i am sorry, but the answer to your question is not covered') or starts_with(lower(trim(case when turn % 4 = 1 then '  The AI service did not respond in time' else text end)), 'the ai service did not respond') as refusal from conversations")
def refusals(spark, d):
    t = F.when(F.col("turn") % 4 == 1, "  The AI service did not respond in time").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_refusal(t).alias("refusal"))


@query(f"""with t as (select doc_id, 'ISBN-13: 978-' || lpad((doc_id * 7919 % 1000)::varchar, 3, '0') || '-1234567 (print) isbn 978' || lpad((doc_id * 7919 % 10000000000)::varchar, 10, '0') || ' or ISBN 12345 ' || coalesce(text, '') as t from documents),
  x as (select doc_id, list_filter(list_transform(regexp_extract_all(upper(t), '{T.ISBN}', 1), lambda x: regexp_replace(x, '[^0-9X]', '', 'g')), lambda x: length(x) in (10, 13)) as x from t)
  select doc_id, array_to_string(list_filter(x, lambda y, i: list_position(x, y) = i), ',') as isbn from x""")
def isbns(spark, d):
    """ISBNs of every document behind an imprint."""
    last = lambda n: F.lpad((F.col("doc_id") * 7919 % 10**n).cast("string"), n, "0")
    text = F.concat(F.lit("ISBN-13: 978-"), last(3), F.lit("-1234567 (print) isbn 978"), last(10), F.lit(" or ISBN 12345 "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.isbns(text), ",").alias("isbn"))


_MARK = T.CITATION.replace("'", "''")


@query(f"""with t as (select conv_id, turn, 'See [Book A, Page ' || turn || '] and[Book B, p. 7]. ' || text || ' [book a,Page ' || (turn + 2) || '] [Book A, Page ' || turn || ']' as t from conversations),
  m as (select *, list_filter(regexp_extract_all(t, '{_MARK}', 0), lambda x: not (lower(trim(regexp_extract(x, '{_MARK}', 1))) = 'book a' and regexp_extract(x, '{_MARK}', 2)::int <= 3)) as bad from t)
  select conv_id, turn, trim(list_reduce([t] || list_reverse_sort(list_transform(bad, lambda x: lpad(length(x)::varchar, 6, '0') || x)), lambda s, x: replace(s, x[7:], ''))) as kept from m""")
def checked_citations(spark, d):
    """Every turn with references before and behind it, of which only Book A up to page 3 is allowed."""
    page = lambda n: (F.col("turn") + n).cast("string")
    t = F.concat(F.lit("See [Book A, Page "), page(0), F.lit("] and[Book B, p. 7]. "), "text", F.lit(" [book a,Page "), page(2), F.lit("] [Book A, Page "), page(0), F.lit("]"))
    allowed = F.array(*[F.struct(F.lit("book a").alias("title"), F.lit(p).alias("page")) for p in range(4)])
    return table(spark, d, "conversations").select("conv_id", "turn", T.kept_citations(t, allowed).alias("kept"))


@query("""with p as (select doc_id, n_chars % 3 = 0 as book, n_chars % 2 = 0 as cited, n_chars % 5 < 2 as more, case when doc_id % 2 = 0 then 'none' else 'textbook' end as said from documents)
  select doc_id, case when book and cited and more then 'partial' when book and cited then 'textbook' when more then 'ai_only' when said = 'none' then 'none' else 'ai_only' end as grounding from p""")
def grounding(spark, d):
    n = F.col("n_chars")
    g = H.grounding(n % 3 == 0, n % 2 == 0, n % 5 < 2, F.when(F.col("doc_id") % 2 == 0, "none").otherwise("textbook"))
    return table(spark, d, "documents").select("doc_id", g.alias("grounding"))


@query("""with s as (select o_custkey as query_id, o_orderpriority as book, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, o_totalprice / 100000 - 2 as score from orders),
  c as (select distinct o_custkey as query_id, lower(o_orderpriority) as b from orders where o_orderstatus = 'P'), f as (select query_id, lower(book) as b, min(rank) as rank, arg_min(book, rank) as book from s where score >= 0 and (query_id, lower(book)) not in (select query_id, b from c) group by 1, 2)
  select query_id, book, place from (select query_id, book, row_number() over (partition by query_id order by rank, b) as place from f) where place <= 4""")
def also_in_books(spark, d):
    from pyspark.sql.window import Window

    o = table(spark, d, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    s = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("book"), rank.alias("rank"), (F.col("o_totalprice") / 100000 - 2).alias("score"))
    c = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("book"))
    return H.also_in(s, c).withColumn("place", F.col("place").cast("long"))


@query("""with r as (select o_orderkey, o_orderpriority as topic, row_number() over (partition by o_orderstatus, lower(o_orderpriority) order by o_orderkey) as n, o_orderstatus as subject from orders)
  select o_orderkey, case when subject = 'F' and lower(topic) in ('1-urgent', '2-high') then 'Priority' when subject = 'F' and lower(topic) = '5-low' then 'Low' when subject = 'P' and lower(topic) in ('5-low', '4-not specified') then 'Low' end as canonical from r""")
def canonical_topics(spark, d):
    rows = [("F", "Priority", "1-urgent"), ("F", "Priority", "2-high"), ("F", "Low", "5-low"), ("P", "Low", "5-low"), ("P", "Low", "4-not specified")]
    taxonomy = spark.createDataFrame(rows, "subject string, topic string, alias string")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("subject"), F.col("o_orderpriority").alias("label"))
    return B.canonical(o, taxonomy).select("o_orderkey", F.col("topic").alias("canonical"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'Surgery' when 1 then 'Medicine' end as faculty, day(o_orderdate)::int as day, strftime(o_orderdate, '%b') as month, year(o_orderdate)::int as year, case when o_orderkey % 3 = 0 then 'M+E' end as session from orders""")
def paper_names(spark, d):
    head = F.when(F.col("o_orderkey") % 4 == 0, "Surg").when(F.col("o_orderkey") % 4 == 1, "med.").otherwise("Other")
    name = F.concat(head, F.lit(" "), F.date_format("o_orderdate", "d MMM yyyy"), F.when(F.col("o_orderkey") % 3 == 0, " (M+E)").otherwise(""))
    parsed = T.paper_name(name, {"surg": "Surgery", "med": "Medicine"})
    return table(spark, d, "orders").select("o_orderkey", parsed.alias("p")).select("o_orderkey", "p.*")


# Pages and books


@query(r"""select doc_id from documents where not (length(text) >= 400 and len(regexp_extract_all(text, '[A-Za-z)][^,\n]{0,40},\s*\d{1,4}(?:\s*[a-z])?\s*[,.=;]')) * 1000.0::double / length(text) > 6)""")
def index_pages_dropped(spark, d):
    return table(spark, d, "documents").filter(T.index_density(F.col("text")) <= 6).select("doc_id")


@query(f"""with c as (select conv_id as book, turn as id, turn as page, {_WORDS} as w, role = 'user' as child from conversations),
  p as (select a.book, a.id as old_id, b.id as new_id, abs(a.page - b.page) as away, b.page as new_page, round(len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))) * case when a.page = b.page then 1.0::double else 0.9::double end * case when a.child = (not b.child) then 1.0::double else 0.85::double end, 6) as score
    from c a join c b on a.book = b.book and abs(a.page - b.page) <= 1 where len(a.w) > 0 and len(b.w) > 0)
  select book, old_id, new_id, score from p where score >= 0.3 qualify row_number() over (partition by book, old_id order by score desc, away, new_page, new_id) = 1""")
def successor_passages(spark, d):
    """Turns as passages of two editions; in the new one each is of the other kind."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("id"), F.col("turn").alias("page"), "text", (F.col("role") == "user").alias("child"))
    return B.matched_passages(c, c.withColumn("child", ~F.col("child")))


@query("""with h as (select doc_id, source as outline, case doc_id % 4 when 0 then [] when 1 then ['Part', upper(source)] else ['Part', 'Section ' || doc_id % 7] end as headings from documents)
  select doc_id, case when doc_id % 5 = 0 then case when len(headings) > 0 then array_to_string(headings, ' > ') end when len(headings) = 0 or contains(lower(outline), lower(headings[-1])) then outline else outline || ' > ' || headings[-1] end as chapter from h""")
def chapter_names(spark, d):
    part, n = F.lit("Part"), F.col("doc_id") % 4
    headings = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(part, F.upper("source"))).otherwise(F.array(part, F.concat(F.lit("Section "), (F.col("doc_id") % 7).cast("string"))))
    outline = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    return table(spark, d, "documents").select("doc_id", B.chapter_name(outline, headings).alias("chapter"))


@query("select doc_id, md5('Textbook: ' || source || ' | Chapter: ' || case when doc_id % 3 = 0 then 'N/A' else lang end || ' | Page: ' || n_chars || chr(10) || text) as m from documents")
def context_prefixes(spark, d):
    text = B.context_prefix(F.col("source"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.col("n_chars"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("m"))


@query(r"""select page_id, regexp_matches(case when page_id % 3 = 0 then '| a | b |' || chr(10) || '|---|---|' || chr(10) || html else html end, '\|.*\|.*?\n\|[-:| ]+\|') or contains(lower(url), 'table') as is_table from pages""")
def table_passages(spark, d):
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("| a | b |\n|---|---|\n"), "html")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", T.is_table(text, F.col("url")).alias("is_table"))


@query("""with p as (select user_id as book, row_number() over (partition by user_id order by event_id) - 1 as page, count(*) over (partition by user_id) as n from events),
  m as (select book, page, case when page = 0 then 'Cover' when page % 10 = 4 then 'Contents' when page = n - 2 then 'Index' when page % 10 = 0 then 'Chapter ' || page end as title from p where page % 10 in (0, 4) or page = n - 2),
  e as (select book, page, title, (select min(page) from m x where x.book = m.book and x.page > m.page) as nxt, (select max(n) from p where p.book = m.book) as n from m where title in ('Cover', 'Contents', 'Index'))
  select distinct book, unnest(range(page, least(coalesce(nxt, case when title = 'Index' then n else page + 1 end), n))) as page from e""")
def front_matter(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("book"), "event_id")
    w = Window.partitionBy("book")
    p = e.select("book", (F.row_number().over(w.orderBy("event_id")) - 1).cast("long").alias("page"), F.count(F.lit(1)).over(w).alias("n"), F.lit("").alias("text"))
    title = F.when(F.col("page") == 0, "Cover").when(F.col("page") % 10 == 4, "Contents").when(F.col("page") == F.col("n") - 2, "Index").when(F.col("page") % 10 == 0, F.concat(F.lit("Chapter "), F.col("page").cast("string")))
    marks = p.withColumn("title", title).filter("title is not null").select("book", "page", "title")
    return B.skipped_pages(p.drop("n"), marks)


@query("""select source as book, count(*) as pages, count(*) filter (length(trim(text)) < 60 and doc_id % 2 = 0) as scanned, count(*) filter (length(trim(text)) < 60 and doc_id % 2 = 0) >= 0.02 * count(*) as read_images from documents group by 1""")
def scanned_books(spark, d):
    p = table(spark, d, "documents").select(F.col("source").alias("book"), "text", (F.col("doc_id") % 2 == 0).alias("has_image"))
    return B.needs_reading(p, least=60, share=0.02)


@query("select o_orderkey, least(w, h) < 120 or greatest(w, h)::double / greatest(least(w, h), 1) > 6 or o_totalprice / 10 < 8000 as decorative from (select *, o_custkey % 900 as w, o_orderkey % 1300 as h from orders)")
def decorative_figures(spark, d):
    return table(spark, d, "orders").select("o_orderkey", B.decorative(F.col("o_custkey") % 900, F.col("o_orderkey") % 1300, F.col("o_totalprice") / 10).alias("decorative"))


@query("""with x as (select l_suppkey as book, (l_orderkey * 7 % 60) * 10 as lo, (l_orderkey * 7 % 60) * 10 + l_quantity::int as hi from lineitem),
  m as (select *, coalesce(max(hi) over (partition by book order by lo, hi rows between unbounded preceding and 1 preceding), -1) as reach from x), i as (select *, sum(case when lo > reach then 1 else 0 end) over (partition by book order by lo, hi) as g from m),
  u as (select book, min(lo) as lo, max(hi) as hi from i group by book, g), s as (select s_suppkey as book, unnest(range(0, 600, 25)) as lo from supplier)
  select book, s.lo, s.lo + 25 as hi from s join u using (book) where u.lo <= s.lo and s.lo + 25 <= u.hi""")
def resumed_slices(spark, d):
    lo = (F.col("l_orderkey") * 7 % 60) * 10
    done = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("book"), lo.alias("lo"), (lo + F.col("l_quantity").cast("int")).alias("hi"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("book"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(575).cast("long"), F.lit(25).cast("long"))).alias("lo"))
    return B.covered_slices(s.withColumn("hi", F.col("lo") + 25), done)


@query()
def page_labels(spark, d):
    """Printed page numbers of users' events as books: three of four pages show the right number, with stray ones about."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("book"), "event_id")
    page = F.row_number().over(Window.partitionBy("book").orderBy("event_id")).cast("int")
    p = e.withColumn("page", page)
    shown = F.when(F.col("event_id") % 4 != 0, F.col("page") + 10)
    numbers = F.array_compact(F.array(shown, F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 997).cast("int"))))
    return B.page_labels(p.select("book", "page", numbers.alias("numbers")))


@query()
def line_segments(spark, d):
    """Boxes of words joined to line segments."""
    x = (F.col("l_partkey") % 50) / 50
    boxes = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), x.alias("x0"), ((F.col("l_linenumber") % 7) / 10).alias("y0"), (x + 0.015).alias("x1"), ((F.col("l_linenumber") % 7) / 10 + 0.01).alias("y1"))
    return O.joined_boxes(R.dealt(boxes, "page"))


@query("""with c as (select page_id, 'Figure ' || page_id || '.1 Front view. Fig. ' || page_id || '-2a Side view; see Figure 9.9 too' as t from pages)
  select page_id, unnest([page_id || '.1', page_id || '.2a', '9.9']) as number, unnest(['Figure ' || page_id || '.1 Front view.', 'Fig. ' || page_id || '-2a Side view; see', 'Figure 9.9 too']) as caption from c where false
  union all select page_id, unnest([page_id || '.1', page_id || '.2a']) as number, unnest(['Figure ' || page_id || '.1 Front view.', 'Fig. ' || page_id || '-2a Side view; see Figure 9.9 too']) as caption from c""")
def split_captions(spark, d):
    n = F.col("page_id").cast("string")
    t = F.concat(F.lit("Figure "), n, F.lit(".1 Front view. Fig. "), n, F.lit("-2a Side view; see Figure 9.9 too"))
    return table(spark, d, "pages").select("page_id", F.explode(T.captions(t)).alias("c")).select("page_id", "c.number", "c.caption")


@query("""with r as (select o_orderkey as id, case o_orderstatus when 'F' then 'supported' when 'O' then 'books_conflict' else 'x' end as said, o_custkey % 4 as quotes, o_custkey % 3 as books from orders)
  select id, case when said not in ('supported', 'contradicted', 'books_conflict', 'textbooks_silent') then 'textbooks_silent' when said <> 'textbooks_silent' and quotes = 0 then 'textbooks_silent' when said = 'books_conflict' and books < 2 then 'textbooks_silent' else said end as verdict from r""")
def referee_verdicts(spark, d):
    said = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "books_conflict").otherwise("x")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.verdict(said, F.col("o_custkey") % 4, F.col("o_custkey") % 3).alias("verdict"))


@query("""select c_custkey, case when y between 1950 and 2035 then y end as year, case when e between 1 and 60 then e end as edition, case when c_custkey % 2 = 0 then '978' || c_custkey end as isbn from (select c_custkey, 1900 + c_custkey % 200 as y, c_custkey % 90 as e from customer)""")
def checked_metadata(spark, d):
    isbn = F.concat(F.lit("978"), F.col("c_custkey").cast("string"))
    seen = F.when(F.col("c_custkey") % 2 == 0, F.array(isbn)).otherwise(F.array(F.lit("x")))
    return table(spark, d, "customer").select("c_custkey", *[c.alias(n) for n, c in B.metadata_checks(1900 + F.col("c_custkey") % 200, F.col("c_custkey") % 90, isbn, seen).items()])


@query("""select 'concept' as type, replace(text, chr(10), ' ') as content, source as book_title, n_chars::varchar as page_number, '' as created_at from documents
  union all select 'mcq', replace(text, chr(10), ' '), '', '', '' from benchmark""")
def bookmarks_table(spark, d):
    none = F.lit(None).cast("timestamp")
    concepts = table(spark, d, "documents").select(F.col("text").alias("content"), F.col("source").alias("book_title"), F.col("n_chars").alias("page_number"), none.alias("created_at"))
    return files.bookmarks_csv(concepts, table(spark, d, "benchmark").select(F.col("text").alias("content"), none.alias("created_at")))


@query("""with l as (select l_orderkey, string_agg('Supplier ' || l_suppkey || ' p.' || l_linenumber || ': q' || l_partkey, ' | ' order by l_linenumber, l_suppkey, l_partkey) as evidence from lineitem group by 1)
  select o_custkey as page, o_orderkey as id, o_orderpriority as question, o_orderstatus as answer, case o_orderstatus when 'F' then 'contradicted' when 'P' then 'books_conflict' end as verdict, coalesce(evidence, '') as evidence from orders left join l on l_orderkey = o_orderkey where o_orderstatus in ('F', 'P')""")
def disputed_report(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("x"))
    evidence = F.transform("x", lambda e: F.struct(F.concat(F.lit("Supplier "), e["l_suppkey"].cast("string")).alias("book"), e["l_linenumber"].alias("page"), F.concat(F.lit("q"), e["l_partkey"].cast("string")).alias("quote")))
    verdict = F.when(F.col("o_orderstatus") == "F", "contradicted").when(F.col("o_orderstatus") == "P", "books_conflict").otherwise("supported")
    rows = table(spark, d, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return files.disputed_report(rows.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), verdict.alias("verdict"), evidence.alias("evidence")))


@query("""select c_custkey, case c_custkey % 4 when 0 then 'Golden questions' when 1 then 'Acute ' || case when c_nationkey % 2 = 0 then 'GI' else 'Renal' end || ' CNS' when 2 then 'med' else 'Other Thing' end as topic from customer""")
def topics_of_files(spark, d):
    n, part = F.col("c_custkey") % 4, F.when(F.col("c_nationkey") % 2 == 0, "gi").otherwise("renal")
    stem = F.when(n == 0, "med_golden_set").when(n == 1, F.concat(F.lit("med_p2_acute_"), part, F.lit("_cns"))).when(n == 2, "med_").otherwise("other_thing")
    return table(spark, d, "customer").select("c_custkey", T.topic_of_file(stem, F.lit("med"), {"gi": "GI"}).alias("topic"))


@query("""select doc_id, case when doc_id % 2 = 0 then '# A' || chr(10) || '- kept [Book A, Page 1]' || chr(10) || 'plain' || chr(10) || '# C' || chr(10) || '* rhyme (AI mnemonic)' else 'intro ' || doc_id end as sheet from documents""")
def checked_sheets(spark, d):
    """Bullets that cite nothing allowed go, and headings with nothing under them."""
    full = F.lit("# A\n- kept [Book A, Page 1]\n- no source\n\n- wrong [Book B, Page 9]\nplain\n# B\n- none\n# C\n* rhyme (AI mnemonic)\n# D")
    sheet = F.when(F.col("doc_id") % 2 == 0, full).otherwise(F.concat(F.lit("intro "), F.col("doc_id").cast("string"), F.lit("\n\n# bare")))
    allowed = F.array(F.struct(F.lit("book a").alias("title"), F.lit(1).alias("page")))
    return table(spark, d, "documents").select("doc_id", T.kept_lines(sheet, allowed).alias("sheet"))
