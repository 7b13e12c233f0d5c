"""The record loader: sample -> limit -> dedup -> normalise -> upsert.

Everything is a DataFrame plan over the raw records; the reference's
per-record loop becomes per-row status columns:

* ``_sampled``  -- P13, a seeded hash of the record's content (reproducible
  under any partitioning, and computable by other engines);
* ``reject_reason`` -- K8, missing fields / unreadable timestamp / bad JSON;
* ``_status``   -- ``error`` / ``duplicate`` / ``add`` (J7: the key is in the
  table already, or an earlier record in arrival order has it);
* the import limit (L1) counts *added* records in arrival order: the N-th
  added record's arrival key is an order statistic (``selection.kth``), rows after it are not
  processed, except the one sampled record that trips the limit.

Normalising (K5) gives four DataFrames. The names of the records are grouped
first, which leaves a row a track; only tracks whose names, album or artist
came in several forms are looked up again for their latest added record (W4:
``max_by`` over arrival order, which aggregates partially, so a hot artist is
never one task). :class:`SnowflakeStore` applies them (K1/K2).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from encore.functions.records import UNREAD_TIME, parse_records
from encore.functions.timefn import freeform_timestamp
from encore.operators.selection import RANGE_ROWS, keys_of, kth, not_after
from encore.schema import Snowflake, conform
from encore.session import scratch_path, ship_package, written_at
from encore.sources import fs
from encore.sources.files import ORDER_COLS

KEY = ["timestamp", "track_id"]
#: Each id, and what a record says of it.
NAMED = {"artist_id": ["artist_name"], "album_id": ["album_title", "artist_id"], "track_id": ["track_title", "album_id"]}
NAMES = ["artist_id", "artist_name", "album_id", "album_title", "track_id", "track_title"]


@dataclass(frozen=True)
class LoadOptions:
    skip_errors: bool = False
    limit: int | None = None
    sample: float | None = None
    seed: int | None = None
    no_duplicates: bool = False
    id_mode: str = "import"
    freeform: bool = True
    materialize: bool = True

    def validate(self) -> None:
        if self.sample is not None and not (0.0 <= self.sample <= 1.0):
            raise ValueError(f"an import can sample a share from 0 to 1, not {self.sample}")
        if self.seed is not None and self.sample is None:
            raise ValueError("a seed is of use only with a share to sample")
        if self.limit is not None and self.limit < 0:
            raise ValueError("a limit cannot be below 0")


def sample_keep(keys: list[Column], fraction: float, seed: int | None) -> Column:
    """Keep a record iff ``md5(seed|content)`` falls below ``fraction`` of 2^32."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed if seed is not None else 0)), *[k.cast("string") for k in keys]))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return bucket < F.lit(int(round(fraction * 4294967296)))


def _arrival() -> Column:
    return F.struct(*[F.col(c) for c in ORDER_COLS])


@dataclass
class LoadPlan:
    """Lazy DataFrames describing one load; nothing is written until committed."""

    rows: DataFrame  # every record with status columns
    added: DataFrame  # parsed rows that will be upserted
    options: LoadOptions
    scratch: str | None = None  # folder of the written records
    keyed: DataFrame | None = None  # records that have the keys of ``added``, repeats among them; None if keys that stand elsewhere are left out
    faults: DataFrame | None = None  # records that could not be read, told before repeats are
    tally: DataFrame | None = None  # the summary, without a status for each row; None with a limit
    names: list[str] = field(default_factory=list)  # folders of the records' names

    def normalised(self) -> Snowflake:
        """K5 + W4: four tables from the added rows, latest record per id."""
        if self.keyed is None:
            artists, albums, tracks = _latest_names(self.added)
            plays = self.added.select(*KEY).dropDuplicates(KEY)
        else:
            artists, albums, tracks = self._names()
            plays = self.keyed.select(*KEY).dropDuplicates(KEY)
        return Snowflake(
            conform(artists, "artists"),
            conform(albums, "albums"),
            conform(tracks, "tracks"),
            conform(plays, "plays"),
        )

    def _names(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The three name tables, by way of the names that the records hold: a row a track, and more where they differ.

        A track all of whose records agree has them in its added ones too. The others, with the tracks of an album or
        artist that came in several forms, are settled by their own records.
        """
        named, folder = written_at(self.keyed.select(*NAMES).distinct(), "loads")
        self.names.append(folder)
        forms = named.agg(*[F.count_distinct(i).alias(i) for i in NAMED], *[F.count_distinct(i, *v).alias(f"{i}_forms") for i, v in NAMED.items()], F.count(F.lit(1)).alias("n")).first()
        if forms.n == forms.track_id and all(forms[i] == forms[f"{i}_forms"] for i in NAMED):
            return _distinct_names(named)
        several = []
        for i in NAMED:
            ids = named.groupBy(i).agg(F.count_distinct(*(NAMED[i] if i != "track_id" else [c for c in NAMES if c != i])).alias("_n")).filter("_n > 1").select(i)
            several.append(named.join(ids, i, "left_semi").select("track_id"))
        unsettled = several[0].union(several[1]).union(several[2]).distinct()
        rows = self.keyed.join(unsettled, "track_id", "left_semi")
        if self.options.no_duplicates:
            rows = _mark_again(rows, None).filter(~F.col("_again"))
        settled = _distinct_names(named.join(unsettled, "track_id", "left_anti"))
        # an id on both sides has one form
        return tuple(x.unionByName(y).distinct() for x, y in zip(settled, _latest_names(rows), strict=True))

    def summary(self) -> DataFrame:
        """K6/K7: one row of load statistics (no per-record data leaves the executors)."""
        if self.tally is not None:
            return self.tally
        r = self.rows
        sampled = (
            F.count_if(F.col("_sampled") & F.col("_processed")) if self.options.sample is not None
            else F.lit(None).cast("long")
        )
        return r.agg(
            F.count_if(F.col("_processed")).alias("total_processed"),
            sampled.alias("sampled"),
            F.count_if(F.col("_status") == "added").alias("added"),
            F.count_if(F.col("_status") == "duplicate").alias("skipped"),
            F.count_if(F.col("_status") == "error").alias("errors"),
            F.coalesce(F.max(F.col("_trips_limit")), F.lit(False)).alias("limit_reached"),
            F.min(F.when(F.col("_status") == "added", F.col("timestamp"))).alias("first_timestamp"),
            F.max(F.when(F.col("_status") == "added", F.col("timestamp"))).alias("last_timestamp"),
        )

    def _errors(self) -> DataFrame:
        return self.rows.filter(F.col("_status") == "error") if self.faults is None else self.faults

    def first_errors(self, n: int = 10) -> DataFrame:
        """K8: the first ``n`` error messages in arrival order (a top-k, not a collect)."""
        errs = self._errors()
        cols = ["_line", "reject_reason"] if "_line" in errs.columns else ["reject_reason"]
        return errs.orderBy(*ORDER_COLS).limit(n).select(*ORDER_COLS, *cols)

    def rejects(self) -> DataFrame:
        """K8: every sampled record that could not be read: its file, its line or place, its reason and a digest of its content."""
        errs = self._errors()
        line = F.col("_line") if "_line" in errs.columns else F.lit(None).cast("long")
        return errs.select(
            F.col(ORDER_COLS[0]).alias("file"), line.alias("line"), F.col("reject_reason").alias("reason"), "raw_timestamp",
            F.col("_content").alias("content"),
        )

    def check_errors(self) -> None:
        """Abort mode: fail on the first bad record unless ``skip_errors``."""
        if self.options.skip_errors:
            return
        first = self.first_errors(1).collect()
        if first:
            row = first[0].asDict()
            where = f"Line {row['_line']}: " if row.get("_line") is not None else ""
            raise ValueError(where + row["reject_reason"])

    def release(self) -> None:
        """Delete the written records; the plan, and what it has returned, cannot be read afterwards."""
        for folder in [*([self.scratch] if self.scratch is not None else []), *self.names]:
            fs.delete(self.rows.sparkSession, folder)


def _latest_names(a: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artists, albums and tracks, each as its latest record has it."""
    order = _arrival()
    artists = a.groupBy(F.col("artist_id").alias("id")).agg(
        F.max_by("artist_name", order).alias("name")
    )
    albums = a.groupBy(F.col("album_id").alias("id")).agg(
        F.max_by(F.struct(F.col("album_title").alias("title"), "artist_id"), order).alias("v")
    ).select("id", "v.title", "v.artist_id")
    tracks = a.groupBy(F.col("track_id").alias("id")).agg(
        F.max_by(F.struct(F.col("track_title").alias("title"), "album_id"), order).alias("v")
    ).select("id", "v.title", "v.album_id")
    return artists, albums, tracks


def _distinct_names(named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artists, albums and tracks of names that come in one form each."""
    artists = named.select(F.col("artist_id").alias("id"), F.col("artist_name").alias("name")).distinct()
    albums = named.select(F.col("album_id").alias("id"), F.col("album_title").alias("title"), "artist_id").distinct()
    tracks = named.select(F.col("track_id").alias("id"), F.col("track_title").alias("title"), "album_id").distinct()
    return artists, albums, tracks


def _unread(rows: DataFrame) -> Column:
    """Records whose only fault is a time that no native layout reads."""
    return F.coalesce(F.col("reject_reason").startswith(UNREAD_TIME), F.lit(False))


def _freeform_repair(rows: DataFrame) -> DataFrame:
    """F6 tail: run the free-form parser once per *distinct* unreadable timestamp text.

    Rows the native layouts read never touch Python; the (usually tiny) set of
    failures is parsed and joined back only to the failing rows.
    """
    ship_package(rows.sparkSession)
    bad = _unread(rows)
    failed = rows.filter(bad)
    fixes = failed.select("raw_timestamp").distinct().withColumn(
        "_fixed", freeform_timestamp(F.trim(F.col("raw_timestamp")))
    )
    repaired = (
        failed.join(fixes, "raw_timestamp", "left")
        .withColumn("timestamp", F.col("_fixed"))
        .withColumn("reject_reason", F.when(F.col("_fixed").isNull(), F.col("reject_reason")))
        .drop("_fixed")
    )
    return rows.filter(~bad).unionByName(repaired)


def _mark_again(keyed: DataFrame, existing_plays: DataFrame | None) -> DataFrame:
    """``_again`` where an earlier record, or the table, has the key.

    Keys are counted first (a partial aggregate, so a key repeated without end is one row a task);
    only the keys that repeat are looked at again for their first arrival.
    """
    repeated = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*KEY)
    first = keyed.select(*KEY, _arrival().alias("_a")).join(repeated, KEY, "left_semi").groupBy(*KEY).agg(F.min("_a").alias("_first"))
    keyed = keyed.join(first, KEY, "left").withColumn("_again", F.coalesce(_arrival() != F.col("_first"), F.lit(False))).drop("_first")
    if existing_plays is not None:
        seen = existing_plays.select(*KEY).distinct().withColumn("_exists", F.lit(True))
        keyed = keyed.join(seen, KEY, "left")
        keyed = keyed.withColumn("_again", F.col("_again") | F.coalesce(F.col("_exists"), F.lit(False))).drop("_exists")
    return keyed


def _tally(rows: DataFrame, options: LoadOptions, existing_plays: DataFrame | None) -> DataFrame:
    """K6/K7 without a limit: the summary, and ``unread``, from one aggregation of the keys.

    Of a record only its key and arrival are dealt out; records without a key are one row a task.
    """
    valid = F.col("_sampled") & F.col("reject_reason").isNull()
    state = F.when(~F.col("_sampled"), F.lit("unsampled")).when(F.col("reject_reason").isNotNull(), F.lit("error")).otherwise(F.lit("add"))
    kinds, parts = ["_state", "_unread"], KEY + ORDER_COLS if options.no_duplicates else ["timestamp"]
    each = rows.select(state.alias("_state"), _unread(rows).alias("_unread"), *[F.when(valid, F.col(c)).alias(c) for c in parts])
    each = each.groupBy(*kinds, *parts).agg(F.count(F.lit(1)).alias("n"))
    if options.no_duplicates:
        # records that arrive in the same place are one arrival
        first = F.min(F.struct(*ORDER_COLS, "n"))
        each = each.groupBy(*kinds, *KEY).agg(F.sum("n").alias("n"), first.getField("n").alias("added"))
        if existing_plays is not None:
            each = each.join(existing_plays.select(*KEY).distinct().withColumn("_exists", F.lit(True)), KEY, "left")
            each = each.withColumn("added", F.when(F.col("_exists"), F.lit(0).cast("long")).otherwise(F.col("added")))
    else:
        each = each.withColumn("added", F.col("n"))
    add, none = F.col("_state") == "add", F.lit(0).cast("long")
    total = lambda keep, c="n": F.coalesce(F.sum(F.when(keep, F.col(c))), none)
    when_added = F.when(add & (F.col("added") > 0), F.col("timestamp"))
    return each.agg(
        total(F.lit(True)).alias("total_processed"),
        (total(F.col("_state") != "unsampled") if options.sample is not None else F.lit(None).cast("long")).alias("sampled"),
        total(add, "added").alias("added"),
        (total(add) - total(add, "added")).alias("skipped"),
        total(F.col("_state") == "error").alias("errors"),
        F.lit(False).alias("limit_reached"),
        F.min(when_added).alias("first_timestamp"),
        F.max(when_added).alias("last_timestamp"),
        total(F.col("_unread")).alias("_unread"),
    )


def _parsed(records: DataFrame, options: LoadOptions) -> DataFrame:
    """The parsed records with ``_sampled``, ``reject_reason`` and, where one stands, a digest of the content."""
    carried = [*ORDER_COLS, *[c for c in ("_line",) if c in records.columns]]
    sampled = F.lit(True)
    if options.sample is not None:
        sampled = F.coalesce(sample_keep([F.to_json(F.col("fields"))], options.sample, options.seed), F.lit(False))
    staged = records.select(*carried, "fields", "parse_error", sampled.alias("_sampled"))
    rows = parse_records(staged, id_mode=options.id_mode, keep=[*carried, "fields", "parse_error", "_sampled"])
    rows = rows.withColumn("reject_reason", F.coalesce("parse_error", "reject_reason"))
    content = F.md5(F.coalesce(F.to_json("fields"), F.lit("")))
    return rows.withColumn("_content", F.when(F.col("reject_reason").isNotNull(), content)).drop("fields", "parse_error")


def plan_load(
    records: DataFrame,
    options: LoadOptions = LoadOptions(),
    existing_plays: DataFrame | None = None,
) -> LoadPlan:
    """K4: the loader as a plan over ``records(fields map, parse_error, _file, _block, _pos)``."""
    options.validate()
    spark = records.sparkSession
    rows = _parsed(records, options)
    valid = F.col("_sampled") & F.col("reject_reason").isNull()
    scratch = None
    counts = [F.count_if(_unread(rows)).alias("unread"), F.count_if(~valid).alias("invalid")]
    if options.materialize:
        # Cut lineage once: the parsed records are written as a Parquet table
        # in the shared checkpoint folder (computed once, columnar) and every
        # later step (dedup, limit, summary, the four tables) reads it. The write counts
        # what later steps are needed for.
        scratch = scratch_path(spark, "loads", uuid.uuid4().hex)
        seen = Observation("load")
        rows.observe(seen, *counts).write.parquet(scratch)
        rows = spark.read.schema(rows.schema).parquet(scratch)
        found = seen.get
    else:
        # nothing is kept: one more pass says which steps are needed, each of which would read the records again
        found = rows.agg(*counts).first().asDict()
    any_unread, any_invalid = found["unread"] > 0, found["invalid"] > 0
    if options.freeform and any_unread:
        rows = _freeform_repair(rows)

    read = rows.filter(valid) if any_invalid else rows
    faults = rows.filter(F.col("_sampled") & F.col("reject_reason").isNotNull()) if any_invalid else rows.filter(F.lit(False))
    tally, last = None, None
    if options.limit is None:
        tally = _tally(rows, options, existing_plays).drop("_unread")
    elif options.limit:
        # L1: where the k-th added record arrives, found by counts between sampled keys
        k, keys, arrivals = int(options.limit), keys_of(*ORDER_COLS), read
        if options.no_duplicates:
            if existing_plays is not None:
                arrivals = arrivals.join(existing_plays.select(*KEY), KEY, "left_anti")
            arrivals = arrivals.groupBy(*KEY).agg(F.min(_arrival()).alias("_a")).select("_a.*")
        folder = None
        if k > RANGE_ROWS:
            arrivals, folder = written_at(arrivals.select(*ORDER_COLS), "loads")
        last = kth(arrivals, keys, k)
        if folder is not None:
            fs.delete(spark, folder)
    beyond = None
    if options.limit is not None and (options.limit == 0 or last is not None):
        # The first sampled record past the cutoff trips the limit; records up
        # to it count as processed (the reference reads it, then stops).
        within = not_after(keys, last) if options.limit else F.lit(False)
        beyond = rows.filter(~within).withColumn("_status", F.lit("not_processed"))
        trip = beyond.filter("_sampled").select(F.min(_arrival())).scalar()
        beyond = beyond.withColumn("_trips_limit", F.coalesce(_arrival() == trip, F.lit(False)))
        beyond = beyond.withColumn("_processed", F.coalesce(_arrival() <= trip, F.lit(False)))
        rows, read, faults = rows.filter(within), read.filter(within), faults.filter(within)

    is_dup, keyed = F.lit(False), read
    if options.no_duplicates:
        # First occurrence of each key among valid records, in arrival order. Other records have
        # no key: they are set aside, so that none meets at a null.
        marked = _mark_again(read, existing_plays)
        rows = marked.unionByName(rows.filter(~valid).withColumn("_again", F.lit(False))) if any_invalid else marked
        is_dup = F.col("_again")
        keyed = None if existing_plays is not None else read
    status = (
        F.when(~F.col("_sampled"), F.lit("unsampled"))
        .when(F.col("reject_reason").isNotNull(), F.lit("error"))
        .when(is_dup, F.lit("duplicate"))
        .otherwise(F.lit("added"))
    )
    rows = rows.withColumn("_status", status).drop("_again").withColumn("_trips_limit", F.lit(False)).withColumn("_processed", F.lit(True))
    added = rows.filter(F.col("_status") == "added")
    if beyond is not None:
        rows = rows.unionByName(beyond)
    return LoadPlan(rows=rows, added=added, options=options, scratch=scratch, keyed=keyed, faults=faults, tally=tally)


def dry_run(records: DataFrame, options: LoadOptions = LoadOptions(), existing_plays: DataFrame | None = None) -> DataFrame:
    """K9: the summary that a load would have; nothing is written, not even the parsed records.

    Without a limit the records are read once; once more if there are times that only the free-form parser may read.
    """
    options.validate()
    if options.limit is not None:
        return plan_load(records, replace(options, materialize=False), existing_plays).summary()
    rows = _parsed(records, options)
    tally = _tally(rows, options, existing_plays)
    found = tally.first()
    if options.freeform and found["_unread"]:
        return _tally(_freeform_repair(rows), options, existing_plays).drop("_unread")
    return records.sparkSession.createDataFrame([found], tally.schema).drop("_unread")


def records_from_columns(df: DataFrame, order_cols: list[str], fields: dict[str, Column]) -> DataFrame:
    """Shape a DataFrame of columns as import records (text map + arrival order)."""
    pairs = []
    for k, v in fields.items():
        pairs += [F.lit(k), v.cast("string")]
    order = [F.col(c) if c is not None else F.lit(0) for c in order_cols]
    return df.select(
        F.create_map(*pairs).alias("fields"),
        F.lit(None).cast("string").alias("parse_error"),
        *[c.alias(n) for c, n in zip(order, ORDER_COLS)],
    )


def lineitem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding B as import records: a play of part ``p_name`` (album ``p_type``,
    artist ``p_brand``) at ``l_shipdate``, arriving in (order, line) order."""
    from encore.sources.tables import read_table

    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey)
    j = j.withColumn("_src", F.lit("lineitem"))
    return records_from_columns(
        j,
        ["_src", "l_orderkey", "l_linenumber"],
        {
            "timestamp": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
            "artist": F.col("p_brand"),
            "album": F.col("p_type"),
            "track": F.col("p_name"),
        },
    )
