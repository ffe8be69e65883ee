"""Landed canonical tables that take up batches of fetched pull requests.

A batch is normalised like a load and merged into what is there: of a pull request
fetched again the last line wins, its children are added, and names follow the first
mention of each user, old or new. The result is that of one load of all batches
together, if each batch brings the children of a pull request with or after it.

Only folders with rows that change are written again, each once (dynamic overwrite): new
rows, pull requests fetched again, and rows of users whose first mention changed its name. What
decides about names is kept beside the tables as mergeable state, the first mention
of each user on each pull request (``_mentions``) and the pull requests' own payloads
(``_heads``). Taking up the same batch again changes nothing, so a run that was cut off
is simply repeated.

Facts lie in folders by dump and month of their own time, in files clustered by pull
request; users and state in folders by dump and hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.operators import interning
from mergelens.operators.normalize import Normalizer, Windows
from mergelens.operators.tables import MONTH, PR_KEY, Tables, month_of
from mergelens.sources import files
from mergelens.sources.load import flat_prs, last_copies
from mergelens.sources.staging import Staging

SLOTS = 64  # folders of users and state per dump; must stay what it was at the first batch
SLOT = "slot"
# Per fact table the time of a row and the user it names.
FACTS = {
    "pull_requests": ("created_at", "user"),
    "reviews": ("submitted_at", "user"),
    "commits": ("date", "author"),
    "comments": ("created_at", "user"),
    "timeline": ("created_at", "actor"),
    "files": (None, None),
}
_COPY_ID = {"reviews": ["id"], "commits": ["sha"], "comments": ["type", "id"], "timeline": ["id"], "files": ["filename"]}
_FOLDERS = {name: ["dump_id", MONTH] for name in FACTS} | {
    "users": ["dump_id", SLOT],
    "_heads": ["dump_id", SLOT],
    "_mentions": ["dump_id", SLOT],
    "repositories": ["dump_id"],
    "manifests": ["dump_id"],
}


def _union(*parts: DataFrame | None) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [part for part in parts if part is not None])


def _only(rows: DataFrame | None, keys: DataFrame, names: Sequence[str], how: str = "left_semi") -> DataFrame | None:
    return None if rows is None else rows.join(keys.select(*names), list(names), how)


def _in(rows: DataFrame, places: set[tuple], folders: Sequence[str]) -> DataFrame:
    """Rows of the given folders."""
    by_dump: dict[str, list] = {}
    for dump, *rest in sorted(places):
        by_dump.setdefault(dump, []).extend(rest)
    chosen = [
        (F.col("dump_id") == dump) & F.col(folders[1]).isin(rest) if len(folders) > 1 else F.col("dump_id") == dump
        for dump, rest in by_dump.items()
    ]
    return rows.filter(reduce(Column.__or__, chosen, F.lit(False)))


def _first_of_prs(mentions: DataFrame) -> DataFrame:
    """The first mention of each user on each pull request."""
    first = [F.min_by("seen", "seen_at").alias("seen"), F.min("seen_at").alias("seen_at")]
    return mentions.groupBy(*PR_KEY, "user_id").agg(*first)


class Landing:
    """The tables below one folder of shared storage."""

    def __init__(
        self, spark: SparkSession, path: str, key: str = "number", dedup_children: bool = False, slots: int = SLOTS
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.dedup_children, self.slots = key, dedup_children, slots

    def read(self, name: str) -> DataFrame | None:
        """A landed table, or None before the first batch."""
        try:
            schema = self.spark.read.parquet(f"{self.path}/_schemas/{name}").schema
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        # The declared schema also keeps names of folders as they are.
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def tables(self) -> Tables:
        """What has been landed; facts keep their month, by which periods prune folders."""
        names = (*FACTS, "users", "repositories", "manifests")
        return Tables(**{name: rows.drop(SLOT) for name in names if (rows := self.read(name)) is not None})

    def append(self, raw: dict[str, DataFrame], windows: Windows, manifests: DataFrame) -> None:
        """Take up a batch of raw tables, each with ``dump_id`` and ``line_ord``."""
        staging = Staging(self.spark)
        try:
            self._append(raw, windows, manifests, staging)
        finally:
            staging.close()

    def _append(self, raw: dict[str, DataFrame], windows: Windows, manifests: DataFrame, staging: Staging) -> None:
        norm = Normalizer(windows, self.key)
        heads = self.read("_heads")
        new_prs = staging.table("prs", norm.pull_requests(raw["pull_requests"]))
        known = new_prs
        if heads is not None:
            known = staging.table("known", _union(heads.select(*PR_KEY), new_prs.select(*PR_KEY)).distinct())
        children = {
            "reviews": norm.reviews(raw["reviews"], known),
            "commits": norm.commits(raw["commits"], known),
            "comments": norm.comments(raw["review_comments"], raw["issue_comments"], known),
            "timeline": norm.timeline(raw["timeline"], known),
            "files": norm.files(raw["files"], known),
        }
        children = {name: staging.table(name, rows) for name, rows in children.items()}

        self._merge_heads(heads, new_prs)
        heads = self.read("_heads")
        people, renamed = self._merge_mentions(heads, new_prs, children, staging)

        self._write_prs(heads, new_prs, people, renamed, staging)
        for name, rows in children.items():
            self._write_children(name, rows, norm, people, renamed, staging)
        # Only now, so that a run cut off before finds again whom to rename.
        self._write_users(people, staging)

        dumps = manifests.select("dump_id").distinct()
        places = self._places(dumps, ["dump_id"])
        self._lay("repositories", interning.first_seen_repositories(_only(heads, dumps, ["dump_id"])), places)
        self._lay("manifests", manifests, places)

    def _slot(self, *names: str) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(self.slots)).cast("int")

    def _merge_heads(self, heads: DataFrame | None, new_prs: DataFrame) -> None:
        """Pull requests: the last line wins, the first one keeps its place."""
        fresh = new_prs.withColumn(SLOT, self._slot(*PR_KEY))
        if heads is None:
            return self._lay("_heads", fresh, set())
        places = self._places(fresh, _FOLDERS["_heads"])
        # A pull request is at most once on either side, so rows meet in one join.
        was = _in(heads, places, _FOLDERS["_heads"])
        payload = [name for name in fresh.columns if name not in (*PR_KEY, SLOT)]
        old = was.select(*PR_KEY, F.struct(*payload).alias("_old"))
        both = fresh.select(*PR_KEY, F.struct(*payload).alias("_new")).join(old, PR_KEY, "full")
        newer = F.col("_old").isNull() | (F.col("_new.line_ord") >= F.col("_old.line_ord"))
        last = F.when(newer, F.col("_new")).otherwise(F.col("_old"))
        first = F.least("_old.first_ord", "_new.first_ord").alias("first_ord")
        rest = [name for name in payload if name != "first_ord"]
        merged = both.select(*PR_KEY, last.alias("last"), first)
        merged = merged.select(*PR_KEY, *[F.col(f"last.{name}").alias(name) for name in rest], "first_ord")
        self._lay("_heads", merged.withColumn(SLOT, self._slot(*PR_KEY)), places)

    def _merge_mentions(
        self, heads: DataFrame, new_prs: DataFrame, children: dict[str, DataFrame], staging: Staging
    ) -> tuple[DataFrame, DataFrame | None]:
        """Bring mentions up to date; returns the users they are about, and those with another name or type, if any."""
        old, carry, person = self.read("_mentions"), PR_KEY[1:], ["dump_id", "user_id"]
        present = heads if old is None else _only(heads, new_prs, PR_KEY)
        fresh = interning.child_mentions(
            children["reviews"], children["commits"], children["comments"], children["timeline"], carry
        ).unionByName(interning.pr_mentions(present, carry))
        fresh = staging.table("mentions", _first_of_prs(fresh).withColumn(SLOT, self._slot(*PR_KEY)))
        gone, places, merged = None, set(), fresh
        if old is not None:
            # What a pull request's earlier payload said goes; what its children said stays.
            gone = old.filter(interning.introduced_by_pr()).join(new_prs.select(*PR_KEY), PR_KEY, "left_semi")
            gone = staging.table("old_mentions", gone.select(*PR_KEY, "user_id", SLOT))
            folders, key = _FOLDERS["_mentions"], [*PR_KEY, "user_id"]
            places = self._places(_union(fresh.select(*folders), gone.select(*folders)), folders)
            # A user is named once on a pull request by either side, so they meet in one join.
            was = _only(_in(old, places, folders), gone, key, "left_anti")
            was = was.select(*key, F.col("seen").alias("_seen"), F.col("seen_at").alias("_seen_at"))
            both = was.join(fresh.drop(SLOT), key, "full")
            earlier = F.col("seen_at").isNull() | (F.col("_seen_at") <= F.col("seen_at"))
            first = [F.when(earlier, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("seen", "seen_at")]
            merged = both.select(*key, *first).withColumn(SLOT, self._slot(*PR_KEY))
        self._lay("_mentions", merged, places)

        affected = _union(fresh.select(*person), None if gone is None else gone.select(*person)).distinct()
        affected = staging.table("affected", affected)
        first = interning.first_mentions(_only(self.read("_mentions"), affected, person))
        # A user who is named no more has no login.
        ids = affected.withColumnRenamed("user_id", "id")
        people = ids.join(interning.users_of(first), ["dump_id", "id"], "left").withColumn(SLOT, self._slot("dump_id", "id"))
        people = staging.table("people", people)
        users = self.read("users")
        if users is None:
            return people, None
        was = users.select("dump_id", "id", F.col("login").alias("_login"), F.col("type").alias("_type"))
        other = ~F.col("login").eqNullSafe(F.col("_login")) | ~F.col("type").eqNullSafe(F.col("_type"))
        renamed = people.filter(F.col("login").isNotNull()).join(was, ["dump_id", "id"]).filter(other)
        renamed = staging.table("renamed", renamed.select("dump_id", "id", "login", "type"))
        return people, None if renamed.isEmpty() else renamed

    def _write_users(self, people: DataFrame, staging: Staging) -> None:
        now, users, folders = people.filter(F.col("login").isNotNull()), self.read("users"), _FOLDERS["users"]
        if users is None:
            return self._lay("users", now, set())
        places = self._places(people, folders)
        others = _only(_in(users, places, folders), people, ["dump_id", "id"], "left_anti")
        self._lay("users", _union(others, now), places)

    def _write_prs(
        self, heads: DataFrame, new_prs: DataFrame, people: DataFrame, renamed: DataFrame | None, staging: Staging
    ) -> None:
        old = self.read("pull_requests")
        present = heads if old is None else _only(heads, new_prs, PR_KEY)
        new = flat_prs(interning.named(present.drop(SLOT), people, "user"))
        out = None
        if old is not None:
            new = staging.table("pull_requests-new", new)
            out = staging.table("pull_requests-out", _only(old.select(*PR_KEY, MONTH), new_prs, PR_KEY))
        self._write_facts("pull_requests", new, new, out, PR_KEY, renamed)

    def _write_children(
        self, name: str, new: DataFrame, norm: Normalizer, people: DataFrame, renamed: DataFrame | None, staging: Staging
    ) -> None:
        user, fetched = FACTS[name][1], new
        if name == "commits":
            new = norm.usable_commits(new).withColumn("committer_id", F.col("committer.id")).drop("committer")
        if user is not None:
            new = interning.named(new, people, user)
        old, out = self.read(name), None
        line = [*PR_KEY, "line_ord", *(["type"] if name == "comments" else []), *(["filename"] if name == "files" else [])]
        if old is not None:
            # A batch taken up before is there already.
            copy = [*PR_KEY, *_COPY_ID[name]]
            narrow = old.select(*dict.fromkeys([*line, *copy]), MONTH)
            out = _only(narrow, new, line)
            if self.dedup_children:
                out = _union(out, _only(narrow, new, copy)).distinct()
            out = staging.table(f"{name}-out", out)
        if self.dedup_children:
            if out is not None:
                back = self._renamed(_only(old, out, line), name, renamed).drop(MONTH)
                new = _union(_only(back, new, line, "left_anti"), new)
            new = last_copies(new, *_COPY_ID[name])
        self._write_facts(name, new, fetched, out, line, renamed)

    @staticmethod
    def _renamed(rows: DataFrame, name: str, renamed: DataFrame | None) -> DataFrame:
        """Landed rows with present names."""
        user = FACTS[name][1]
        if user is None or renamed is None:
            return rows
        parts = {part: f"{user}_{part}" for part in ("login", "type")}
        now = renamed.select("dump_id", F.col("id").alias(f"{user}_id"), *[F.col(c).alias(f"_{c}") for c in parts])
        marked = rows.join(now, ["dump_id", f"{user}_id"], "left")
        present = {c: F.when(F.col("_login").isNotNull(), F.col(f"_{part}")).otherwise(F.col(c)) for part, c in parts.items()}
        return marked.withColumns(present).select(*rows.columns)

    def _write_facts(
        self,
        name: str,
        new: DataFrame,
        fetched: DataFrame,
        out: DataFrame | None,
        line: Sequence[str],
        renamed: DataFrame | None,
    ) -> None:
        """Add rows to a fact table, without the landed rows ``out`` and with present names in all others.

        Times of new rows are among those of ``fetched`` or lie in folders of ``out``.
        """
        (at, user), old, folders = FACTS[name], self.read(name), _FOLDERS[name]

        def placed(rows: DataFrame) -> DataFrame:
            month = F.lit(0) if at is None else F.coalesce(month_of(F.col(at)), F.lit(0))
            return rows.withColumn(MONTH, month.cast("int"))

        if old is None:
            return self._lay(name, placed(new), set())
        parts = [placed(fetched).select(*folders), out.select(*folders)]
        if user is not None and renamed is not None:
            who = renamed.select("dump_id", F.col("id").alias(f"{user}_id"))
            parts.append(_only(old, who, ["dump_id", f"{user}_id"]).select(*folders))
        places = self._places(_union(*parts), folders)
        rest = _in(old, places, folders)
        if not out.isEmpty():
            rest = _only(rest, out, line, "left_anti")
        self._lay(name, _union(self._renamed(rest, name, renamed), placed(new)), places)

    @staticmethod
    def _places(rows: DataFrame, folders: Sequence[str]) -> set[tuple]:
        """Folders of rows; at most one row per folder reaches the driver."""
        return {tuple(row) for row in rows.select(*folders).distinct().collect()}

    def _lay(self, name: str, rows: DataFrame, places: set[tuple]) -> None:
        """Write rows in place of the folders ``places`` of a table, in one pass; it may read them.

        Folders are replaced after all rows have been read and written elsewhere.
        """
        folders, new = _FOLDERS[name], self.read(name) is None
        before = {place: set(files.names(self.spark, self._folder(name, place))) for place in places}
        by = [*folders, *[c for c in (*PR_KEY, "id") if c in rows.columns and c not in folders]]
        spread = folders
        if MONTH not in folders or FACTS[name][0] is None:
            # Few folders, or one: each is written by several tasks, which take whole pull requests or users.
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            share = -(-tasks // (self.slots if SLOT in folders else 1))
            rows = rows.withColumn("_share", F.pmod(F.hash(*by), F.lit(share)))
            spread = [*folders, "_share"]
        laid = rows.hint("rebalance", *[F.col(c) for c in spread]).sortWithinPartitions(*by).drop("_share")
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(
            f"{self.path}/{name}"
        )
        if new:
            rows.drop("_share").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_schemas/{name}")
        for place, had in before.items():
            # Nothing came in its place: it has lost its last row.
            if had & set(files.names(self.spark, self._folder(name, place))):
                files.delete(self.spark, self._folder(name, place))

    def _folder(self, name: str, place: tuple) -> str:
        catalog = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        parts = [f"{key}={catalog.escapePathName(str(value))}" for key, value in zip(_FOLDERS[name], place)]
        return "/".join([self.path, name, *parts])
