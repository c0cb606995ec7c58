"""Licence scan in built-in functions: TF-IDF cosine and directory inheritance.

Units are compared with templates: the whole text of a file named like a
licence file with whole licence texts, and every line and every paragraph of
every file with headers (titles, notices, clauses).  A paragraph ends at a line
without letters and digits, so comment signs do not matter.  Units and
templates are sparse vectors of all their words, with idf from all files, and a
unit has a template's licence if their cosine reaches ``least``.  Whole texts
decide before headers, then the highest cosine, then the longest template, then
the first licence by name.

A unit that can reach the cosine must have one of the template's heaviest words
(the others together weigh too little), so only units with such a word are
split into words.  That loses no match.

A file named like a licence file gives its licence to its directory; a file
without a licence of its own takes that of the nearest such ancestor.

Defined cases: null texts have no units; null paths inherit nothing; of several
licence files in one directory the one that the order above puts first wins;
rows that repeat a path are rows of their own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aircadence.llm.licenses import FILES, HEADERS, SHARED
from aircadence.workspace import Workspace, broadcast_if_small

LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
PARAGRAPH = r"\n([^A-Za-z0-9\n]*\n)+"
#: Words with more than one in so many of all (file, word) pairs are broadcast.
HOT_WORDS = 100_000

Templates = Sequence[tuple[str, str]]


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_rows(headers: Templates = HEADERS, files: Templates = FILES) -> list[tuple[int, str, bool, bool, str, int]]:
    """``(number, licence, whole, shared, word, count)`` of all templates."""
    both = [(n, t, False) for n, t in headers] + [(n, t, True) for n, t in files]
    return [(k, n, whole, t in SHARED, w, words.count(w)) for k, (n, t, whole) in enumerate(both) if (words := template_words(t)) for w in sorted(set(words))]


def _words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _idf(count: Column, n: int) -> Column:
    return F.log((F.lit(n) + 1.0) / (F.coalesce(count, F.lit(0)) + 1.0)) + 1.0


def _weighed_templates(df: DataFrame, n: int, headers: Templates, files: Templates, least: float) -> list[dict]:
    """Templates' words with their weights; as many rows as the templates have words."""
    table = df.sparkSession.createDataFrame(template_rows(headers, files), "template int, license string, whole boolean, shared boolean, word string, tf int")
    known = df.join(F.broadcast(table.select("word").distinct()), "word", "left_semi")
    weighed = table.join(F.broadcast(known), "word", "left").withColumn("w", F.col("tf") * _idf(F.col("count"), n))
    of = Window.partitionBy("template")
    square = F.col("w") * F.col("w")
    # The lighter words of a template, this one included, as a share of its length.
    lighter = F.sum(square).over(of.orderBy("w", "word"))
    weighed = weighed.withColumn("square", F.sum(square).over(of)).withColumn("anchor", F.sqrt(lighter / F.col("square")) >= least * 0.999)
    return [r.asDict() for r in weighed.collect()]


def _with_idf(counted: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """``counted`` with the idf of its words; frequent words are broadcast, so no key of the join is hot."""
    total = df.agg(F.sum("count")).first()[0] or 0
    hot = df.where(F.col("count") >= total / HOT_WORDS).select("word", F.col("count").alias("hot"))
    cold = df.where(F.col("count") < total / HOT_WORDS).select(F.col("word").alias("at"), F.col("count").alias("cold"))
    marked = counted.join(F.broadcast(hot), "word", "left").withColumn("at", F.when(F.col("hot").isNull(), F.col("word")).otherwise(F.concat(F.lit(" "), F.col("unit"))))
    return marked.join(cold, "at", "left").select(*counted.columns, _idf(F.coalesce("hot", "cold"), n).alias("idf"))


def _matches(units: DataFrame, vectors: list[dict], df: DataFrame, n: int, least: float) -> DataFrame:
    """``(unit, whole, best)``: the template that decides for each distinct unit."""
    template = units.sparkSession.createDataFrame([(v["template"], v["license"], v["whole"], v["shared"], v["word"], v["w"], v["square"]) for v in vectors], "template int, license string, whole boolean, shared boolean, word string, w double, square double")
    distinct = units.groupBy("unit", "whole").agg(F.any_value("content").alias("content"))
    counted = distinct.select("unit", "whole", F.explode(_words("content")).alias("word")).groupBy("unit", "whole", "word").count()
    valued = _with_idf(counted, df, n).select("unit", "whole", "word", (F.col("count") * F.col("idf")).alias("v"))
    # A cosine of ``least`` takes that share of a unit's length in words of templates, so most units end here,
    # before their words meet every template that has them.
    known = valued.join(F.broadcast(template.select("word", "whole", F.lit(True).alias("known")).distinct()), ["word", "whole"], "left")
    square = F.col("v") * F.col("v")
    told = known.groupBy("unit", "whole").agg(F.sum(square).alias("unit_square"), F.sum(F.when(F.col("known"), square)).alias("known_square"), F.collect_list(F.when(F.col("known"), F.struct("word", "v"))).alias("words"))
    near = told.where(F.col("known_square") >= F.col("unit_square") * (least * least * 0.999)).select("unit", "whole", "unit_square", F.inline("words"))
    dots = near.join(F.broadcast(template), ["word", "whole"]).groupBy("unit", "whole", "unit_square", "shared", "template", "license", "square").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    cosine = F.round(F.col("dot") / F.sqrt(F.col("unit_square") * F.col("square")), 6)
    found = dots.withColumn("cosine", cosine).where(F.col("cosine") >= least)
    order = F.struct((~F.col("whole")).cast("int").alias("header"), F.col("shared").cast("int").alias("shared"), (-F.col("cosine")).alias("minus"), (-F.col("square")).alias("shorter"), F.col("license").alias("license"))
    return found.groupBy("unit", "whole").agg(F.min(order).alias("best"))


def license_scan(files: DataFrame, id_col: str, path_col: str, text_col: str, headers: Templates = HEADERS, whole_files: Templates = FILES, least: float = 0.8) -> DataFrame:
    """Per row of ``files``: ``(id_col, path_col, license, cosine, origin)``.

    ``origin`` is "own", "inherited" or null; ``cosine`` is that of the unit
    that decided, rounded to six places.
    """
    work = Workspace(files.sparkSession, "license")
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")

    n = rows.count()
    df = work.stage(rows.where("text is not null").select(F.explode(F.array_distinct(_words("text"))).alias("word")).groupBy("word").count(), "df")
    vectors = _weighed_templates(df, n, headers, whole_files, least)
    anchors = sorted({v["word"] for v in vectors if v["anchor"]})
    pattern = r"(?i)(^|[^a-z0-9])(" + "|".join(anchors) + r")([^a-z0-9]|$)"
    # Equal units are judged once, under a digest of what they hold.
    pieces = F.array_distinct(F.filter(F.concat(F.split("text", "\n"), F.split("text", PARAGRAPH)), lambda x: x.rlike(pattern)))
    unit = F.explode(F.concat(
        F.transform(pieces, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("content"))),
        F.when(F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)), F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("content")))).otherwise(F.array()),
    )).alias("u")
    units = rows.where(F.col("text").rlike(pattern)).select("id", "path", "text_hash", unit).select("id", "path", "text_hash", F.md5("u.content").alias("unit"), "u.*")
    units = work.stage(units, "units")
    best = _matches(units, vectors, df, n, least)
    by_file = units.select("id", "path", "text_hash", "unit", "whole").join(best, ["unit", "whole"]).groupBy("id", "path", "text_hash").agg(F.min("best").alias("best"))
    own = work.stage(by_file, "own")

    # Directories with a licence file, then each directory's nearest one.
    licensed = own.where(name.rlike(LICENSE_FILE)).groupBy(folder.alias("ancestor")).agg(F.min("best").alias("given"))
    licensed = broadcast_if_small(work.stage(licensed, "licensed"))
    folders = rows.where("path is not null").select(folder.alias("folder")).distinct()
    steps = F.split("folder", "/")
    ancestors = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn("ancestor", F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(licensed, "ancestor").groupBy("folder").agg(F.max_by("given", "depth").alias("given"))

    out = rows.select("id", "path", "text_hash", folder.alias("folder")).join(nearest, "folder", "left")
    same = out["id"].eqNullSafe(own["id"]) & out["path"].eqNullSafe(own["path"]) & (out["text_hash"] == own["text_hash"])
    out = out.join(broadcast_if_small(own), same, "left").select(out["id"], out["path"], "best", "given")
    decided = F.coalesce("best", "given")
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), decided["license"].alias("license"), (-decided["minus"]).alias("cosine"),
        F.when(F.col("best").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
    )
