"""Operators on books: repair of lost ligatures, figures of a new edition, chapters from an outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators.ordered import merged_intervals, rising

# Fixed values of the repair: letter groups of which a damaged text keeps only the f.
LIGATURES = ("fi", "fl", "ff", "ffi", "ffl")


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each run of Latin letters occurs, in lower case. Null texts have none."""
    words = F.regexp_extract_all(F.col(text), F.lit("([A-Za-z]+)"))
    return texts.select(F.explode(words).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def ligature_map(target: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """(word, repaired): words of ``target`` (word, n) that ``known`` has fewer than ``least`` times and that become known by
    widening one f to a ligature. Of several repairs the most frequent counts if it has three times its runner-up."""
    known = known.select("word", "n").filter(F.col("n") >= least)
    odd = target.select("word").filter(F.contains("word", F.lit("f"))).distinct().join(known, "word", "left_anti")
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr("word", i, F.lit(1)) == "f")
    made = odd.select("word", F.explode(places).alias("i"))
    made = made.select("word", "i", F.explode(F.array(*[F.lit(x) for x in LIGATURES])).alias("ligature"))
    repaired = F.concat(F.substr("word", F.lit(1), F.col("i") - 1), "ligature", F.substr("word", F.col("i") + 1))
    made = made.select("word", repaired.alias("repaired")).distinct()
    found = made.join(known.withColumnRenamed("word", "repaired"), "repaired")
    order = F.reverse(F.array_sort(F.collect_list(F.struct("n", "repaired"))))  # at most five for each f of a word
    best = found.groupBy("word").agg(order.alias("best"))
    clear = (F.size("best") == 1) | (F.col("best")[0]["n"] >= 3 * F.try_element_at("best", F.lit(2))["n"])
    return best.filter(clear).select("word", F.col("best")[0]["repaired"].alias("repaired"))


def _cased(original: Column, repaired: Column) -> Column:
    """``repaired`` in upper case, with a capital, or as it is, whichever ``original`` shows."""
    capital = F.concat(F.upper(F.left(repaired, F.lit(1))), F.substr(repaired, F.lit(2)))
    return F.when(original == F.upper(original), F.upper(repaired)).when(F.left(original, F.lit(1)).rlike("[A-Z]"), capital).otherwise(repaired)


def repaired_texts(texts: DataFrame, mapping: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` (unique) and ``text`` with the mapped words repaired, case kept. A join on words, so the map may be large; null texts stay."""
    runs = F.regexp_extract_all(F.col(text), F.lit("([A-Za-z]+|[^A-Za-z]+)"))
    rows = texts.select(key, F.posexplode(runs).alias("at", "run"))
    rows = rows.join(mapping, F.lower("run") == F.col("word"), "left")
    run = F.when(F.col("repaired").isNull(), F.col("run")).otherwise(_cased(F.col("run"), F.col("repaired")))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", run.alias("run")))).alias("runs"))
    whole = whole.select(key, F.array_join(F.transform("runs", lambda r: r["run"]), "").alias("_whole"))
    return texts.select(key, text).join(whole, key, "left").select(key, F.coalesce("_whole", text).alias(text))


def matched_figures(old: DataFrame, new: DataFrame, least: float = 0.4) -> DataFrame:
    """(book, old_id, new_id) of figures (book, id, page, label, caption): the same label within a page (least id), else the
    most alike caption of at least ``least``, else, without a caption, the only figure there is. Null pages match nothing."""
    right = new.filter("page is not null").select("book", F.col("id").alias("new_id"), F.col("label").alias("new_label"), T.word_set(F.col("caption")).alias("new_words"), F.explode(F.array(F.col("page") - 1, "page", F.col("page") + 1)).alias("page"))
    rows = old.select("book", F.col("id").alias("old_id"), "page", "label", T.word_set(F.col("caption")).alias("words")).join(right, ["book", "page"])
    alike = F.round(T.jaccard(F.col("words"), F.col("new_words")), 12)
    rows = rows.select("book", "old_id", "new_id", F.col("label").eqNullSafe(F.col("new_label")).alias("same"), alike.alias("alike"), (F.size("words") == 0).alias("bare"))
    of = Window.partitionBy("book", "old_id")
    first = F.row_number().over(of.orderBy(F.desc("same"), F.when(F.col("same"), F.col("new_id")), F.desc("alike"), F.desc("new_id")))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(of)).withColumn("first", first).filter("first = 1")
    return rows.filter(F.col("same") | (F.col("alike") >= least) | (F.col("bare") & (F.col("n") == 1))).select("book", "old_id", "new_id")


def outline_chapters(pages: DataFrame, outline: DataFrame, skipped: str | None = None) -> DataFrame:
    """(book, page, chapter): the titles of the two outermost bookmarks open at each page, outermost first, joined by " > ".

    ``outline`` has (book, page, depth, title); a bookmark closes all of its depth or deeper. Books of fewer than three
    bookmarks, pages before the first one and innermost titles that match ``skipped`` give null.
    """
    of = Window.partitionBy("book")
    marks = outline.withColumn("level", F.col("depth") - F.min("depth").over(of)).withColumn("marks", F.count(F.lit(1)).over(of)).filter("marks >= 3")
    rows = marks.select("book", "page", "level", "title").unionByName(pages.select("book", "page", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title")))
    so_far = of.orderBy("page", F.asc_nulls_last("level"), "title").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct(F.col("page").alias("p"), F.col("title").alias("t"))
    rows = rows.withColumn("outer", F.last(F.when(F.col("level") == 0, here), ignorenulls=True).over(so_far))
    inner = F.when(F.col("level") == 0, F.struct(F.col("page").alias("p"), F.lit(None).cast("string").alias("t"))).when(F.col("level") == 1, here)
    rows = rows.withColumn("inner", F.last(inner, ignorenulls=True).over(so_far)).filter("level is null")
    path = F.concat_ws(" > ", F.col("outer.t"), F.col("inner.t"))
    last = F.coalesce("inner.t", "outer.t")
    keep = last.isNotNull() & ~(last.rlike(skipped) if skipped else F.lit(False))
    return rows.select("book", "page", F.when(keep, path).alias("chapter"))


def matched_passages(old: DataFrame, new: DataFrame, least: float = 0.3) -> DataFrame:
    """(book, old_id, new_id, score): for each old passage (book, id, page, text, child) the new one on its page, or one page away, with most words in common.

    A page away counts 0.9, the other kind of passage 0.85. Passages without words match nothing.
    """
    a = old.select("book", F.col("id").alias("old_id"), F.col("page").alias("old_page"), T.word_set(F.col("text")).alias("a"), F.col("child").alias("child_a")).filter(F.size("a") > 0)
    b = new.select("book", F.col("id").alias("new_id"), F.col("page").alias("new_page"), T.word_set(F.col("text")).alias("b"), F.col("child").alias("child_b")).filter(F.size("b") > 0)
    near = a.withColumn("new_page", F.explode(F.array(F.col("old_page") - 1, F.col("old_page"), F.col("old_page") + 1)))
    rows = near.join(b, ["book", "new_page"])
    away = F.when(F.col("old_page") == F.col("new_page"), 1.0).otherwise(0.9)
    kind = F.when(F.coalesce("child_a", F.lit(True)) == F.col("child_b"), 1.0).otherwise(0.85)
    rows = rows.withColumn("score", F.round(T.jaccard(F.col("a"), F.col("b")) * away * kind, 6)).filter(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("book", "old_id").orderBy(F.desc("score"), F.abs(F.col("old_page") - F.col("new_page")), "new_page", "new_id"))
    return rows.withColumn("_n", best).filter("_n = 1").select("book", "old_id", "new_id", "score")


def edge_numbers(text: Column, lines: int = 3) -> Column:
    """Distinct numbers of up to four digits that stand alone in the first and last ``lines`` lines of a page."""
    rows = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    edge = F.concat(F.slice(rows, 1, lines), F.when(F.size(rows) > 0, F.slice(rows, F.greatest(F.size(rows) - lines + 1, F.lit(1)), F.lit(lines))).otherwise(F.array().cast("array<string>")))
    tokens = F.flatten(F.transform(edge, lambda x: F.split(x, r"[\s|•·]+")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike(r"^\d{1,4}$")), lambda t: t.cast("int"))))


def page_labels(pages: DataFrame, least: float = 0.2) -> DataFrame:
    """(book, page, printed) from the numbers (array ``numbers``) in each page's header and footer; books where too few pages show one have none.

    A number counts if a page one or two away continues its sequence, the best supported one; of the pages' numbers the
    longest rising chain stays. Gaps are filled where the numbering runs on, else from both ends; both ends are extended.
    """
    seen = pages.select("book", "page", F.explode("numbers").alias("v"))
    # page p shows v, page p + d shows v + d: both have the same difference
    line = seen.select("book", "page", "v", (F.col("v") - F.col("page")).alias("off")).distinct()
    w = Window.partitionBy("book", "off").orderBy("page").rangeBetween(-2, 2)
    line = line.withColumn("support", F.count(F.lit(1)).over(w) - 1).filter("support > 0")
    best = F.row_number().over(Window.partitionBy("book", "page").orderBy(F.desc("support"), "v"))
    valid = line.withColumn("_n", best).filter("_n = 1").select("book", "page", "v")
    chain = rising(valid, "book", "page", "v")
    size = pages.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    good = chain.groupBy("book").agg(F.count(F.lit(1)).alias("found")).join(size, "book").filter(F.col("found") >= least * F.col("n")).select("book")
    rows = pages.select("book", "page").join(good, "book", "left_semi").join(chain, ["book", "page"], "left")
    back, on = Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("book").orderBy("page").rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col("v").isNotNull(), F.struct("page", "v"))
    rows = rows.withColumn("a", F.last(here, ignorenulls=True).over(back)).withColumn("b", F.first(here, ignorenulls=True).over(on))
    from_a, from_b = F.col("a.v") + F.col("page") - F.col("a.page"), F.col("b.v") - (F.col("b.page") - F.col("page"))
    middle = F.floor((F.col("a.page") + F.col("b.page")) / 2)
    guess = F.when(F.col("page") <= middle, from_a).otherwise(from_b)
    inner = F.when((guess > F.col("a.v")) & (guess < F.col("b.v")), guess)
    printed = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("a").isNull(), F.when(from_b >= 1, from_b)).when(F.col("b").isNull(), from_a).when(from_a == from_b, from_a).otherwise(inner)
    return rows.select("book", "page", printed.cast("int").alias("printed"))


def chapter_name(outline: Column, headings: Column) -> Column:
    """The outline's chapter with the last heading as its section, unless it is in it already; without an outline the headings' path."""
    section = F.try_element_at(headings, F.lit(-1))
    within = section.isNull() | F.contains(F.lower(outline), F.lower(section))
    path = F.when(F.size(headings) > 0, F.array_join(headings, " > "))
    return F.when(F.coalesce(outline, F.lit("")) == "", path).when(within, outline).otherwise(F.concat(outline, F.lit(" > "), section))


def context_prefix(title: Column, chapter: Column, page: Column, text: Column) -> Column:
    """A passage as it is embedded: with its book, chapter and page before it."""
    or_none = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    return F.concat(F.lit("Textbook: "), or_none(title), F.lit(" | Chapter: "), or_none(chapter), F.lit(" | Page: "), or_none(page), F.lit("\n"), text)


#: Titles of front and back matter.
SKIPPED = (
    r"(?i)^\s*(front\s*cover|cover(\s*page)?|ifc|ibc|back\s*cover|half[\s-]*title(\s*page)?|title(\s*page)?|copyright(\s*page)?|dedication|(table\s+of\s+)?contents|brief\s+contents|"
    r"detailed\s+contents|index|subject\s+index|contributors|list\s+of\s+contributors|acknowledge?ments?|activate\s+your\s+ebook.*|in\s+memory|full\s+page\s+photo.*)\s*$"
)


def skipped_pages(pages: DataFrame, outline: DataFrame, front: int = 40, back: int = 80) -> DataFrame:
    """(book, page) to leave out, pages from 0: those under a bookmark of front or back matter, and list-like ones near either end.

    Such a bookmark reaches to the next one of a later page; the last one is a page long, or to the end for an index.
    """
    size = pages.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    marks = outline.select("book", "page", "title").distinct()
    later = F.min("page").over(Window.partitionBy("book").orderBy("page").rangeBetween(1, Window.unboundedFollowing))
    ends = marks.withColumn("next", later).filter(F.col("title").rlike(SKIPPED)).join(size, "book")
    end = F.least(F.coalesce("next", F.when(F.col("title").rlike("(?i)index"), F.col("n")).otherwise(F.col("page") + 1)), F.col("n"))
    ranges = ends.filter(end > F.col("page")).select("book", F.explode(F.sequence(F.col("page").cast("long"), end.cast("long") - 1)).alias("page"))
    edge = pages.join(size, "book").filter((F.col("page") < front) | (F.col("page") >= F.col("n") - back)).filter(T.is_list_like(F.col("text"))).select("book", F.col("page").cast("long").alias("page"))
    return ranges.union(edge).distinct()


def needs_reading(pages: DataFrame, least: int = 40, share: float = 0.25) -> DataFrame:
    """Per book (book, page, text, has_image): pages, those with an image and next to no text, and whether they are enough to read the book's images."""
    bare = (F.length(F.trim(F.coalesce("text", F.lit("")))) < least) & F.col("has_image")
    by = pages.groupBy("book").agg(F.count(F.lit(1)).alias("pages"), F.count_if(bare).alias("scanned"))
    return by.withColumn("read_images", F.col("scanned") >= share * F.col("pages"))


def decorative(width: Column, height: Column, n_bytes: Column, side: int = 120, aspect: float = 6.0, least: int = 8000) -> Column:
    """Icons, rules and codes: a short side, a long shape or few bytes."""
    short, long = F.least(width, height), F.greatest(width, height)
    return (short < side) | (long / F.greatest(short, F.lit(1)) > aspect) | (n_bytes < least)


def covered_slices(slices: DataFrame, done: DataFrame) -> DataFrame:
    """``slices`` (book, lo, hi) that the union of ``done`` (book, lo, hi) holds whole: to resume at those left."""
    union = merged_intervals(done, "book")
    inside = slices.join(union.select("book", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "book").filter((F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
    return inside.select("book", "lo", "hi").distinct()


def canonical(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``rows`` (subject, label) with the topic that the label means within its subject, by (subject, topic, alias); null if none."""
    names = taxonomy.select("subject", "topic", F.lower("alias").alias("_label")).union(taxonomy.select("subject", "topic", F.lower("topic"))).distinct()
    return rows.withColumn("_label", F.lower(F.trim("label"))).join(names, ["subject", "_label"], "left").drop("_label")  # Spark sends the names to all tasks if they are as few as they should be


def metadata_checks(year: Column, edition: Column, isbn: Column, seen: Column) -> dict[str, Column]:
    """What may stay of a book's details: a year and an edition that can be, an ISBN that its text has."""
    return {"year": F.when(year.between(1950, 2035), year), "edition": F.when(edition.between(1, 60), edition), "isbn": F.when(F.array_contains(seen, isbn), isbn)}
