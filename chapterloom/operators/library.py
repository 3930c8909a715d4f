"""The library: keyed state, incremental update, bulk results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import entry_id


def upsert(library: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Merge ``changes`` (library columns plus ``order``) by id.

    The last change of an id wins; ``created_at`` is kept from the stored row,
    else taken from the id's first change. Changes are folded per id before the
    join, so repeated changes of one id never meet in one task.
    """
    columns = library.columns
    value_columns = [c for c in columns if c not in ("id", "created_at")]
    folded = changes.groupBy("id").agg(
        F.max_by(F.struct(*value_columns), F.col(order)).alias("_new"),
        F.min_by("created_at", F.col(order)).alias("_created"),
    )
    stored = library.select("id", F.struct(*value_columns).alias("_old"), F.col("created_at").alias("_kept"))
    merged = stored.join(folded, "id", "full_outer")
    return merged.select(
        "id",
        F.coalesce("_kept", "_created").alias("created_at"),
        F.coalesce("_new", "_old").alias("_v"),
    ).select("id", "created_at", "_v.*").select(*columns)


def get_entries(library: DataFrame, ids: DataFrame) -> DataFrame:
    """Look up ids; an unknown one comes back with ``detail`` set."""
    wanted = ids.select("id").distinct()
    found = library.withColumn("_known", F.lit(True))
    return wanted.join(found, "id", "left").withColumn(
        "detail", F.when(F.col("_known").isNull(), F.lit("unknown_entry"))
    ).drop("_known")


def delete_entries(library: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining library, removed rows)."""
    gone = ids.select("id").distinct()
    return library.join(gone, "id", "left_anti"), library.join(gone, "id", "left_semi")


def unreferenced_files(listing: DataFrame, live: DataFrame, under: str) -> DataFrame:
    """Files of ``listing`` (file_path) below the folder ``under`` that no live entry (file_path) names, each once.

    A file that several entries share stays until the last of them is gone; ``live`` may unite several snapshots.
    """
    inside = listing.select("file_path").filter(F.col("file_path").startswith(under.rstrip("/") + "/")).distinct()
    return inside.join(live.select("file_path").filter("file_path is not null"), "file_path", "left_anti")


def record_conversions(metadata: DataFrame, chapters: DataFrame, files: DataFrame) -> DataFrame:
    """Library rows from finished conversions.

    ``chapter_count`` is the source position of the last delivered chapter, so
    that an update resumes right behind it. ``metadata`` carries source_url,
    site, title, author, language, cover_url and the time ``at``.
    """
    last = chapters.groupBy("novel_id").agg(
        F.max("chapter_index").alias("chapter_count"),
        F.max_by("url", "chapter_index").alias("last_chapter_url"),
    )
    return (
        metadata.join(last, "novel_id", "left")
        .join(files.select("novel_id", "file_path"), "novel_id", "left")
        .select(
            entry_id(F.col("source_url")).alias("id"),
            "source_url",
            F.coalesce("site", F.lit("unknown")).alias("parser"),
            "title",
            "author",
            "language",
            "cover_url",
            "file_path",
            F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"),
            "last_chapter_url",
            F.col("at").alias("created_at"),
            F.col("at").alias("updated_at"),
        )
    )


def most_recent_first(library: DataFrame) -> DataFrame:
    return library.orderBy(F.desc("updated_at"), "id")


def new_chapters(library: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows past the stored count. ``catalog`` is keyed by ``id``."""
    stored = library.select("id", "chapter_count")
    return catalog.join(stored, "id").filter(F.col("chapter_index") > F.col("chapter_count")).drop("chapter_count")


def shifted_lists(library: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries whose stored last URL is no longer at its place: (id, expected, found).

    The equi-join on (id, position) touches one catalog row per entry; a list
    shorter than the count has no such row and is not flagged.
    """
    stored = library.filter(
        (F.coalesce("last_chapter_url", F.lit("")) != "") & (F.col("chapter_count") > 0)
    ).select("id", F.col("chapter_count").cast("long").alias("chapter_index"), F.col("last_chapter_url").alias("expected"))
    at = catalog.select("id", F.col("chapter_index").cast("long").alias("chapter_index"), F.col("url").alias("found"))
    return stored.join(at, ["id", "chapter_index"]).filter("expected <> found").select("id", "expected", "found")


def _attempts(library: DataFrame, catalog: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """New chapters with what became of them; without outcomes all succeeded."""
    fresh = new_chapters(library, catalog)
    if outcomes is None:
        return fresh.withColumns(
            {"attempted": F.lit(True), "failed": F.lit(False), "reason": F.lit(None).cast("string")}
        )
    o = outcomes.select("id", "chapter_index", "failed", "reason", F.lit(True).alias("attempted"))
    return fresh.join(o, ["id", "chapter_index"], "left").fillna(False, ["attempted", "failed"])


def update_all(
    library: DataFrame,
    catalog: DataFrame,
    outcomes: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Update every entry in one set of joins; one entry's failure is its own row.

    ``library`` has id, title, has_file, chapter_count, last_chapter_url;
    ``catalog`` has id, chapter_index, title, url. ``outcomes`` (id,
    chapter_index, failed, reason) lists attempted downloads, ``errors`` (id,
    detail) the entries whose site failed. Result: id, title, status,
    added_chapters, chapter_count, last_chapter_url, detail: one row per entry.
    ``update_warnings`` has the warnings of ``detail`` as rows.
    """
    entries = library.filter("has_file")
    expected = F.when((F.coalesce("last_chapter_url", F.lit("")) != "") & (F.col("chapter_count") > 0), F.col("last_chapter_url"))
    known = entries.select("id", F.col("chapter_count").alias("_count"), expected.alias("_expected"))
    # The catalog from each entry's last chapter on, that one included: it tells whether the list has shifted.
    tail = catalog.select("id", "chapter_index", "title", "url").join(known, "id").filter(F.col("chapter_index") >= F.col("_count"))
    new = F.col("chapter_index") > F.col("_count")
    shifted = F.coalesce(F.bool_or(~new & (F.col("url") != F.col("_expected"))), F.lit(False)).alias("_shifted")
    if outcomes is None:
        # Nothing stopped, and the new chapters are the added ones.
        tail = tail.withColumns({"failed": F.lit(False), "reason": F.lit(None).cast("string"), "_added": new})
    else:
        o = outcomes.select("id", "chapter_index", "failed", "reason", F.lit(True).alias("_attempted"))
        tail = tail.join(o, ["id", "chapter_index"], "left")
        stops = tail.groupBy("id").agg(F.min(F.when(new & F.col("_attempted").isNull(), F.col("chapter_index"))).alias("_stop"))
        tail = tail.join(stops, "id").withColumn("_added", new & (F.col("_stop").isNull() | (F.col("chapter_index") < F.col("_stop"))))
    added = F.col("_added")
    text = F.when(added & F.coalesce("failed", F.lit(False)), F.struct("chapter_index", _warning().alias("warning")))
    found = tail.groupBy("id").agg(
        F.count_if(new).alias("_new"),
        F.count_if(added).alias("_added"),
        F.max(F.when(added, F.col("chapter_index"))).alias("_last"),
        F.max_by("url", F.when(added, F.col("chapter_index"))).alias("_last_url"),
        F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda x: x["warning"]), "; ").alias("_notes"),
        shifted,
    )
    state = library.join(found, "id", "left")
    if errors is None:
        state = state.withColumn("_error", F.lit(None).cast("string"))
    else:
        state = state.join(errors.select("id", F.col("detail").alias("_error")), "id", "left")
    n_new, n_added = F.coalesce("_new", F.lit(0)), F.coalesce("_added", F.lit(0))
    status = (
        F.when(~F.col("has_file"), F.lit("no_file"))
        .when(F.col("_error").isNotNull(), F.lit("error"))
        .when(n_new == 0, F.lit("up_to_date"))
        .when(n_added < n_new, F.lit("stopped"))
        .otherwise(F.lit("updated"))
    )
    changed = F.col("status").isin("stopped", "updated") & (n_added > 0)
    state = state.withColumn("status", status).withColumn("_changed", changed)

    shift = F.when(F.col("_shifted"), F.lit("chapter_list_shifted"))
    joined = F.nullif(F.concat_ws("; ", shift, F.nullif("_notes", F.lit(""))), F.lit(""))
    detail = (
        F.when(F.col("status") == "no_file", F.lit("no_epub_on_disk"))
        .when(F.col("status") == "error", F.col("_error"))
        .when(F.col("_changed"), joined)
    )
    return state.select(
        "id",
        "title",
        "status",
        F.when(F.col("_changed"), n_added).otherwise(F.lit(0)).alias("added_chapters"),
        F.when(F.col("_changed"), F.col("_last")).otherwise(F.col("chapter_count")).cast("long").alias("chapter_count"),
        F.when(F.col("_changed"), F.col("_last_url")).otherwise(F.col("last_chapter_url")).alias("last_chapter_url"),
        detail.alias("detail"),
    )


def _warning() -> Column:
    return F.concat(F.lit("#"), F.col("chapter_index").cast("string"), F.lit(" "), F.col("title"), F.lit(": "), F.col("reason"))


def update_warnings(library: DataFrame, catalog: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Failed chapters of an update, a row each, up to the chapter at which an entry stopped."""
    tries = _attempts(library.filter("has_file"), catalog, outcomes)
    stops = tries.filter("NOT attempted").groupBy("id").agg(F.min("chapter_index").alias("_stop"))
    added = tries.join(stops, "id", "left").filter(F.col("_stop").isNull() | (F.col("chapter_index") < F.col("_stop")))
    return added.filter("failed").select("id", "chapter_index", _warning().alias("warning"))


def with_rewrites(results: DataFrame, rewritten: DataFrame, library: DataFrame) -> DataFrame:
    """Results of an update in which an archive that could not be rewritten (id, payload, detail) is an error and keeps its count."""
    lost = rewritten.filter("payload is null").select("id", F.col("detail").alias("_lost"))
    stored = library.select("id", F.col("chapter_count").alias("_count"), F.col("last_chapter_url").alias("_url"))
    failed = F.col("_lost").isNotNull()
    return results.join(lost, "id", "left").join(stored, "id").select(
        "id",
        "title",
        F.when(failed, F.lit("error")).otherwise(F.col("status")).alias("status"),
        F.when(failed, F.lit(0)).otherwise(F.col("added_chapters")).alias("added_chapters"),
        F.when(failed, F.col("_count").cast("long")).otherwise(F.col("chapter_count")).alias("chapter_count"),
        F.when(failed, F.col("_url")).otherwise(F.col("last_chapter_url")).alias("last_chapter_url"),
        F.coalesce("_lost", "detail").alias("detail"),
    )


def apply_updates(library: DataFrame, results: DataFrame, at) -> DataFrame:
    """Library after an update: changed entries get count, last URL and time ``at``."""
    one = results.filter("added_chapters > 0").select(
        "id", F.col("chapter_count").alias("_count"), F.col("last_chapter_url").alias("_url"), F.lit(True).alias("_hit")
    )
    return library.join(one, "id", "left").withColumns(
        {
            "chapter_count": F.coalesce(F.col("_count"), F.col("chapter_count").cast("long")),
            "last_chapter_url": F.when(F.col("_hit"), F.col("_url")).otherwise(F.col("last_chapter_url")),
            "updated_at": F.when(F.col("_hit"), at).otherwise(F.col("updated_at")),
        }
    ).drop("_count", "_url", "_hit")


def update_counts(results: DataFrame) -> DataFrame:
    """Totals of a bulk update; only real errors count as failed."""
    return results.agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("status") == "updated").alias("updated"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def series_prefix(results: DataFrame, stops: DataFrame) -> DataFrame:
    """Entries finished before a bulk run was stopped.

    ``results`` has (run_id, position); ``stops`` (run_id, stop_at) names the
    first position that was not started any more.
    """
    return (
        results.join(stops.select("run_id", "stop_at"), "run_id", "left")
        .filter(F.col("stop_at").isNull() | (F.col("position") < F.col("stop_at")))
        .drop("stop_at")
    )


def download_status(requests: DataFrame, library: DataFrame, inventory: DataFrame) -> DataFrame:
    """What a download request for an entry would meet."""
    known = library.select("id", "file_path", F.lit(True).alias("_known"))
    files = inventory.select(F.col("file_path")).distinct().withColumn("_there", F.lit(True))
    return (
        requests.join(known, "id", "left")
        .join(files, "file_path", "left")
        .withColumn(
            "download",
            F.when(F.col("_known").isNull(), F.lit("unknown_entry"))
            .when(F.coalesce("file_path", F.lit("")) == "", F.lit("no_epub_on_disk"))
            .when(F.col("_there").isNull(), F.lit("epub_file_missing"))
            .otherwise(F.lit("ok")),
        )
        .drop("_known", "_there")
    )
