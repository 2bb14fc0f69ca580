"""Checks of records that a package, a review or a profile keeps: ids, names, kinds, policies, roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrid.functions import scalar
from scenegrid.functions.geometry import let


def first_code(*rules: tuple[Column, str], good: str = "ok") -> Column:
    """The code of the first rule that is true. An unknown rule isn't true."""
    code = F.lit(good)
    for broken, name in reversed(rules):
        code = F.when(broken, name).otherwise(code)
    return code


def id_codes(records: DataFrame, scene: str, key: str) -> DataFrame:
    """Ids that aren't positive or come more than once in their scene, each once: scene, key, code. A null id isn't positive."""
    n = records.groupBy(scene, key).agg(F.count("*").alias("_n"))
    bad = F.coalesce(F.col(key) <= 0, F.lit(True))
    code = first_code((bad, "not_positive"), (F.col("_n") > 1, "repeated"), good="")
    return n.select(scene, key, code.alias("code")).where("code <> ''")


def repeated_families(faces: DataFrame, family: Column, face: str) -> DataFrame:
    """Families by their lower-case name: family, n, different faces, and whether a profile names it twice."""
    g = faces.groupBy(F.lower(family).alias("family")).agg(F.count("*").alias("n"), F.countDistinct(face).alias("faces"))
    return g.withColumn("repeated", F.col("n") > 1)


def unlisted_fonts(fonts: Column, allowed: str) -> Column:
    """The font names of an array, in their one form, that don't match a pattern."""
    return F.filter(F.transform(fonts, scalar.font_name), lambda f: ~f.rlike(allowed))


def register_types(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """ext, n and a code for each extension of ``wanted`` (ext, type) against ``known`` (ext, known): ``registered`` if new,
    ``known`` if it is there with that type, ``conflict`` otherwise or where it is wanted with several types."""
    g = wanted.distinct().groupBy("ext").agg(F.count("*").alias("n"), F.min("type").alias("type"))
    code = first_code((F.col("n") > 1, "conflict"), (F.col("known").isNull(), "registered"), (F.col("known") != F.col("type"), "conflict"), good="known")
    return g.join(known, "ext", "left").select("ext", "n", code.alias("code"))


def listed(records: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``records`` with ``listed``: whether ``allowed`` has a row of the same keys."""
    has = allowed.select(*keys).distinct().withColumn("listed", F.lit(True))
    return records.join(has, list(keys), "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def missing_roles(reviews: DataFrame, review: str, role: str, required: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Per review the ``known`` roles that it lacks, and ``needs_further_review`` unless it has the ``required`` ones."""
    seen = reviews.groupBy(review).agg(F.collect_set(role).alias("_seen"))
    lacks = lambda roles: F.array_except(F.array(*map(F.lit, roles)), F.col("_seen"))
    status = F.when(F.size(lacks(required)) == 0, "no_observed_issue").otherwise("needs_further_review")
    return seen.select(review, lacks(known).alias("missing"), status.alias("status"))


def next_runs(runs: DataFrame, job: str, run: Column, width: int = 4) -> DataFrame:
    """job, the number after its last run (1 for none), and the run's name."""
    g = runs.groupBy(job).agg((F.coalesce(F.max(run), F.lit(0)) + 1).alias("run"))
    return g.withColumn("name", F.concat(F.lit("run-"), F.lpad(F.col("run").cast("string"), width, "0")))


def owners(uses: DataFrame, mask: str, parent: Column) -> DataFrame:
    """mask, the different parents that use it, in order, and the number of uses."""
    return uses.groupBy(mask).agg(F.sort_array(F.collect_set(parent)).alias("parents"), F.count("*").alias("n"))


def collisions(left: DataFrame, right: DataFrame) -> DataFrame:
    """The values that two one-column tables share, each once."""
    return left.intersect(right.toDF(*left.columns))


def described(contents: DataFrame, key: str, content: str) -> DataFrame:
    """key, sha256, bytes and kind of contents that are taken in."""
    kind = F.when(F.startswith(F.col(content), F.lit("<")), "markup").when(F.col(content) == "", "empty").otherwise("text")
    return contents.select(key, F.sha2(content, 256).alias("sha"), F.octet_length(content).cast("long").alias("n_bytes"), kind.alias("kind"))


def receipt(*fields: str) -> Column:
    """Fields as compact JSON in the order given."""
    return F.to_json(F.struct(*fields))


def audit_status(errors: Column, unresolved: Column) -> Column:
    """One status of a scene: any error fails it; what isn't resolved leaves it open."""
    return F.when(errors > 0, "FAIL").when(unresolved > 0, "UNRESOLVED").otherwise("VERIFIED_IN_DECLARED_SCOPE")


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?"
_TOKENS = rf'{_STRING}|{_NUMBER}|[^"0-9-]++|[\s\S]'


def typed_json(text: Column) -> Column:
    """A text that two JSON records share exactly if they are equal with their types: 1, 1.0, "1" and true differ, 1.0 and 10e-1 don't; the order of keys, blanks and escapes
    don't count, the order of lists does. Whole numbers are compared at any length, others as doubles. Null for null, for what isn't one JSON value, for repeated keys and numbers beyond doubles."""

    def tagged(t: Column) -> Column:
        # strings, keys too, begin with s; a number is an object whose key can't be one of the record, so it is no key itself
        real = t.try_cast("double")
        number = F.when(~t.rlike("[.eE]"), F.concat(F.lit("i"), F.when(t == "-0", "0").otherwise(t))).when(F.abs(real) < float("inf"), F.concat(F.lit("f"), real.cast("string")))
        return F.when(t.rlike('(?s)^".+"$'), F.concat(F.lit('"s'), F.substr(t, F.lit(2)))).when(t.rlike(f"^{_NUMBER}$"), F.coalesce(F.concat(F.lit('{"n":"'), number, F.lit('"}')), F.lit("?"))).otherwise(t)

    def inner(tokens: Column) -> Column:
        # the parser stops after the first value: brackets that close more than they open and commas outside of all are found here
        marks = F.split(F.regexp_replace(F.array_join(F.filter(tokens, lambda t: ~t.rlike('^["0-9]|^-[0-9]')), ""), r"[^\[\]{},]", ""), "")
        step = lambda a, c: F.when(a < 0, a).when(c.isin("[", "{"), a + 1).when(c.isin("]", "}"), a - 1).when((c == ",") & (a == 0), -1).otherwise(a)
        whole = F.aggregate(marks, F.lit(0), step) == 0
        return F.when(whole, F.to_json(F.try_parse_json(F.concat(F.lit("["), F.array_join(F.transform(tokens, tagged), ""), F.lit("]")))))

    return F.when(F.trim(text) != "", let(F.regexp_extract_all(text, F.lit(_TOKENS), 0), inner))


def same_json(left: Column, right: Column) -> Column:
    """``equal``, and ``code``: ``unread`` where a side is no JSON value; that equals nothing."""
    both = F.struct(typed_json(left).alias("l"), typed_json(right).alias("r"))
    code = lambda s: F.when(s["l"].isNull() | s["r"].isNull(), "unread")
    return let(both, lambda s: F.struct(F.coalesce(s["l"] == s["r"], F.lit(False)).alias("equal"), code(s).alias("code")))


def replayed(kept: DataFrame, again: DataFrame, key: str, content: str) -> DataFrame:
    """Receipts against the ones that are computed again, by key: key and status ``equal``, ``differs``, ``missing`` (not computed again), ``extra`` (not kept), ``unread`` or ``repeated`` (a key that
    a side has more than once). A null key is a key like any other."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"n_{n}"), F.min(typed_json(F.col(content))).alias(n))
    a, b = side(kept, "l"), side(again, "r").withColumnRenamed(key, "_key")
    status = (
        F.when((F.col("n_l") > 1) | (F.col("n_r") > 1), "repeated")
        .when(F.col("n_r").isNull(), "missing")
        .when(F.col("n_l").isNull(), "extra")
        .when(F.col("l").isNull() | F.col("r").isNull(), "unread")
        .when(F.col("l") == F.col("r"), "equal")
        .otherwise("differs")
    )
    return a.join(b, a[key].eqNullSafe(b["_key"]), "full").select(F.coalesce(F.col(key), F.col("_key")).alias(key), status.alias("status"))
