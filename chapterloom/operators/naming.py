"""Collision-free file names without ever overwriting one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .ordering import top_k, with_ordinal

#: Fixed value: the plain name and the suffixes -2 .. -999.
LIMIT = 999
_SUFFIX = r"^(.+)-([2-9]|[1-9]\d{1,2})$"


def _name(slug: Column, k: Column) -> Column:
    return F.when(k == 1, slug).otherwise(F.concat(slug, F.lit("-"), k.cast("string")))


def _linked_roots(slugs: DataFrame) -> DataFrame:
    """Slugs whose generated names may meet another slug: (slug, root).

    "x-2" can meet the second "x". Each slug's chain of shortened forms is
    exploded (a slug has at most 80 characters, so the chain is short) and the
    longest unbroken run of forms that really occur leads to the root.
    """
    chain = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        F.array(F.col("slug")),
        lambda acc, _: F.when(
            F.element_at(acc, -1).rlike(_SUFFIX),
            F.array_append(acc, F.regexp_extract(F.element_at(acc, -1), _SUFFIX, 1)),
        ).otherwise(acc),
    )
    forms = slugs.select("slug", F.posexplode(chain).alias("level", "form"))
    present = slugs.select(F.col("slug").alias("form"), F.lit(True).alias("there"))
    seen = forms.join(present, "form", "left")
    broken = seen.groupBy("slug").agg(
        F.coalesce(F.min(F.when(F.col("there").isNull(), F.col("level"))), F.lit(99)).alias("gap")
    )
    roots = (
        seen.join(broken, "slug").filter(F.col("level") < F.col("gap"))
        .groupBy("slug").agg(F.max_by("form", "level").alias("root"))
    )
    shared = roots.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    return roots.join(shared, "root", "left_semi")


def free_names(arrivals: DataFrame, existing: DataFrame) -> DataFrame:
    """Give each arrival (slug, arrival) the first free name, in arrival order.

    ``existing`` has ``stem`` (names in use, without extension). Output adds
    ``stem``; it is null where all 999 names are taken. Only the first 999
    arrivals of a slug can get one, whatever the slug's popularity.
    """
    taken = existing.select(F.explode(
        F.array(
            F.struct(F.col("stem").alias("slug"), F.lit(1).alias("k")),
            F.struct(
                F.regexp_extract("stem", _SUFFIX, 1).alias("slug"),
                F.regexp_extract("stem", _SUFFIX, 2).try_cast("int").alias("k"),
            ),
        )
    ).alias("u")).select("u.*").filter("slug <> ''")
    slugs = arrivals.select("slug").distinct()
    used = taken.join(slugs, "slug", "left_semi").groupBy("slug").agg(F.collect_set("k").alias("used"))
    linked = _linked_roots(slugs)

    ranked = with_ordinal(arrivals, ["slug"], ["arrival"], "_rank").join(used, "slug", "left")
    free = F.array_except(
        F.sequence(F.lit(1), F.lit(LIMIT)), F.coalesce("used", F.array().cast("array<int>"))
    )
    k = F.get(free, (F.col("_rank") - 1).cast("int"))
    alone = ranked.join(linked, "slug", "left_anti").withColumn(
        "stem", F.when(F.col("_rank") <= LIMIT, _name(F.col("slug"), k))
    )

    # Slugs that can meet each other need the arrivals in sequence, but never
    # more than 999 per slug; the others of these slugs find no name anyway.
    meeting = ranked.join(linked, "slug")
    candidates = top_k(meeting, ["slug"], [F.col("arrival")], LIMIT, "_r").drop("_r")

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        given: set[str] = set()
        stems = []
        blocked = {
            row.slug: set() if row.used is None else set(row.used) for row in group.itertuples()
        }
        rows = group.sort_values("arrival")
        for row in rows.itertuples():
            names = (
                (n, row.slug if n == 1 else f"{row.slug}-{n}")
                for n in range(1, LIMIT + 1) if n not in blocked[row.slug]
            )
            stem = next((name for _, name in names if name not in given), None)
            if stem:
                given.add(stem)
            stems.append(stem)
        return rows.assign(stem=stems)[["slug", "arrival", "stem"]]

    kind = arrivals.schema["arrival"].dataType.simpleString()
    named = candidates.groupBy("root").applyInPandas(assign, f"slug string, arrival {kind}, stem string")
    joined = meeting.join(named, ["slug", "arrival"], "left")
    columns = [*arrivals.columns, "stem"]
    return alone.select(*columns).unionByName(joined.select(*columns))
