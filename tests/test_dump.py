"""Dump folders: scans, windows, interning, failures, sinks."""

import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mergelens.functions.times import iso_text
from mergelens.operators.tables import Tables
from mergelens.plans.report import dataset_summary, report_header
from mergelens.session import configure
from mergelens.sources import dump, load, schemas, sinks
from mergelens.sources.manifest import ManifestError, read_manifest, read_manifests

MANIFEST = {
    "provider": "github",
    "api_version": "2022-11-28",
    "user": "alice",
    "from": "2026-01-01T00:00:00Z",
    "to": "2026-01-31T00:00:00Z",
    "repositories": ["org/repo"],
    "notes": "test",
}


def user(ident, login, **more):
    return {"id": ident, "login": login, **more}


ALICE, BOB, CAROL = user(1, "alice", type="User"), user(2, "bob"), user(3, "carol", type=None)
ROBOT = user(4, "robot", type="Bot")
OWNER = user(90, "org", type="")
REPO = {"id": 10, "name": "repo", "full_name": "org/repo", "owner": OWNER}


def at(day, clock="00:00:00Z"):
    return f"2026-01-{day:02d}T{clock}"


def pr(number, author=ALICE, created=at(2), repo=REPO, **more):
    return {
        "id": 1000 + number, "number": number, "title": f"PR {number}", "state": "open", "user": author,
        "created_at": created, "base": {"label": "b", "ref": "main", "sha": "s", "user": OWNER, "repo": repo},
        "head": {"label": "h", "ref": "topic", "sha": "t", "user": author}, "unknown_field": [1, 2], **more,
    }


def review(ident, number, who=BOB, when=at(3), state="APPROVED", **more):
    url = f"https://api.example.org/repos/org/repo/pulls/{number}"
    return {"id": ident, "user": who, "state": state, "submitted_at": when, "pull_request_url": url, **more}


def commit(sha, number, author=ALICE, when=at(4), message="m", committer=None, **more):
    meta = {"message": message, "author": {"date": when}}
    return {"sha": sha, "commit": meta, "author": author, "committer": committer, "pull_request_number": number, **more}


def issue_comment(ident, number, who=BOB, when=at(5)):
    url = f"https://api.example.org/repos/org/repo/issues/{number}"
    return {"id": ident, "user": who, "body": "x", "created_at": when, "issue_url": url}


def review_comment(ident, number, who=BOB, when=at(5), review_id=None, path="a.py"):
    url = f"https://api.example.org/repos/org/repo/pulls/{number}"
    return {"id": ident, "user": who, "body": "x", "created_at": when, "pull_request_url": url,
            "pull_request_review_id": review_id, "path": path, "position": 1}


def event(ident, url, actor=BOB, when=at(6), name="labeled"):
    return {"id": ident, "url": url, "event": name, "actor": actor, "created_at": when}


def changed(number, name="a.py"):
    return {"sha": "f", "filename": name, "additions": 1, "deletions": 0, "changes": 1, "status": "added", "pull_request_number": number}


FILES = {
    "prs": "pull_requests", "reviews": "reviews", "commits": "commits", "issue_comments": "issue_comments",
    "review_comments": "review_comments", "timeline": "timeline", "files": "files",
}


def write(root, manifest=MANIFEST, **tables):
    os.makedirs(root / "canonical", exist_ok=True)
    if manifest is not None:
        (root / "dump_manifest.json").write_text(json.dumps(manifest, indent=2))
    for name, rows in tables.items():
        lines = [row if isinstance(row, str) else json.dumps(row) for row in rows]
        (root / "canonical" / f"{FILES[name]}.jsonl").write_text("\n".join(lines) + "\n")
    return str(root)


def ids(rows, column="id"):
    return sorted(row[0] for row in rows.select(column).collect())


# --- manifest ---


def test_manifest_fields(spark, tmp_path):
    manifest = read_manifest(spark, write(tmp_path / "one"))
    row = manifest.frame(spark).select("*", iso_text(F.col("start_date")).alias("start")).first()
    assert (row.dump_id, row.provider, row.user_login, row.repositories) == (
        str(tmp_path / "one"), "github", "alice", ["org/repo"]
    )
    assert row.start == "2026-01-01T00:00:00.000000Z"


@pytest.mark.parametrize(
    "text, error",
    [
        (None, ManifestError),
        ("{not json", ManifestError),
        ("", ManifestError),
        (json.dumps({k: v for k, v in MANIFEST.items() if k != "provider"}), ManifestError),
        (json.dumps({**MANIFEST, "provider": "other"}), ValueError),
        (json.dumps({k: v for k, v in MANIFEST.items() if k != "user"}), KeyError),
    ],
)
def test_unusable_manifest(spark, tmp_path, text, error):
    root = write(tmp_path / "bad", manifest=None)
    if text is not None:
        (tmp_path / "bad" / "dump_manifest.json").write_text(text)
    with pytest.raises(error):
        load.read_dump(spark, root)


def test_manifest_inside_canonical_is_not_read(spark, tmp_path):
    root = write(tmp_path / "d", manifest=None)
    (tmp_path / "d" / "canonical" / "dump_manifest.json").write_text(json.dumps(MANIFEST))
    with pytest.raises(ManifestError):
        read_manifest(spark, root)


# --- load ---


def test_absent_tables_are_empty(spark, tmp_path):
    tables = load.read_dump(spark, write(tmp_path / "d", prs=[pr(1)]))
    counts = {r.table: r.rows for r in dataset_summary(tables).collect()}
    assert counts == {"users": 2, "repositories": 1, "pull_requests": 1, "commits": 0, "reviews": 0, "comments": 0}


def test_window_is_inclusive_and_links_need_a_known_pr(spark, tmp_path):
    root = write(
        tmp_path / "d",
        prs=[pr(1, created=at(1)), pr(2, created=at(31)), pr(3, created="2025-12-31T23:59:59.999999Z"),
             pr(4, created="2026-01-31T00:00:00.000001Z"), pr(5, created="2026-01-01T01:00:00+02:00")],
        reviews=[review(1, 1, when=at(1)), review(2, 1, when=at(31)), review(3, 1, when=at(31, "00:00:01Z")),
                 review(4, 3), review(5, 99), review(6, 2, who=None, when="2025-01-01T00:00:00Z")],
        files=[changed(1), changed(3)],
    )
    tables = load.read_dump(spark, root)
    assert ids(tables.pull_requests, "number") == [1, 2]
    # The null user lies outside the window and does not matter.
    assert ids(tables.reviews) == [1, 2]
    assert ids(tables.files, "number") == [1]


def test_review_states_and_user_types(spark, tmp_path):
    states = ["APPROVED", "Changes_Requested", "commented", "DISMISSED", "PENDING"]
    root = write(
        tmp_path / "d",
        prs=[pr(1)],
        reviews=[review(i, 1, who, state=s) for i, (s, who) in enumerate(zip(states, [BOB, CAROL, ROBOT, BOB, BOB]))],
    )
    tables = load.read_dump(spark, root)
    rows = {r.id: (r.state, r.user_type) for r in tables.reviews.collect()}
    assert rows[0] == ("approved", "User")
    assert rows[1] == ("changes_requested", "User")
    assert rows[2] == ("commented", "Bot")
    assert rows[3][0] == rows[4][0] == "commented"
    types = {r.login: r.type for r in tables.users.collect()}
    assert types["org"] == "Organization"  # seen as owner first, where an empty type means an organization


def test_owner_type_defaults_to_organization(spark, tmp_path):
    repo = {**REPO, "owner": user(91, "acme")}
    tables = load.read_dump(spark, write(tmp_path / "d", prs=[pr(1, repo=repo)]))
    assert {r.login: r.type for r in tables.users.collect()}["acme"] == "Organization"


def test_commit_rules(spark, tmp_path):
    root = write(
        tmp_path / "d",
        prs=[pr(1)],
        commits=[
            commit("ok", 1, idx=0),
            commit("committer", 1, committer=BOB),
            commit("nodate", 1, when=None),
            commit("emptydate", 1, when=""),
            commit("noauthor", 1, author=None, committer=BOB),
            commit("nomessage", 1, message="", author=user(50, "ghost")),
            commit("nonumber", None),
            commit("badcommitter", 1, author=user(51, "seen"), committer=user(None, "x")),
            {"sha": "nometa", "author": ALICE, "pull_request_number": 1},
        ],
    )
    tables = load.read_dump(spark, root)
    rows = {r.sha: (r.author_login, r.committer_id) for r in tables.commits.collect()}
    assert rows == {"ok": ("alice", 1), "committer": ("alice", 2)}
    # Authors of skipped commits were seen all the same.
    assert {"ghost", "seen"} <= {r.login for r in tables.users.collect()}


def test_checks_pass_over_rows_left_out_when_stages_are_not_generated(spark, tmp_path):
    """Wide stages run as separate operators; a check must not see rows that an earlier condition drops."""
    root = write(
        tmp_path / "d", prs=[pr(1)], commits=[commit("a", 1), commit("b", 1, when=None), commit("c", 1, when="")],
        timeline=[event(1, "https://x/1/timeline"), event(2, "https://x/1/timeline", when=None), event(3, "https://x/a/b")],
    )
    configure(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "1")
    spark.conf.set("spark.sql.subexpressionElimination.skipForShortcutExpr", "false")
    try:
        tables = load.read_dump(spark, root)
        assert (ids(tables.commits, "sha"), ids(tables.timeline)) == (["a"], [1])
    finally:
        configure(spark)


def test_timeline_rules(spark, tmp_path):
    base = "https://api.example.org/repos/org/repo/issues"
    root = write(
        tmp_path / "d",
        prs=[pr(1)],
        timeline=[
            event(1, f"{base}/1/timeline"),
            event(2, f"{base}/1/timeline/"),
            event(3, f"{base}/events/123"),
            event(4, ""),
            event(5, f"{base}/1/timeline", actor=None),
            event(6, f"{base}/1/timeline", when=None),
            event(7, f"{base}/2/timeline"),
            {k: v for k, v in event(8, "").items() if k != "url"},
            {**event(9, f"{base}/events/9"), "pull_request_number": 1},
        ],
    )
    assert ids(load.read_dump(spark, root).timeline) == [1, 2, 9]


def test_comments_of_both_kinds(spark, tmp_path):
    root = write(
        tmp_path / "d", prs=[pr(1)], issue_comments=[issue_comment(1, 1), issue_comment(2, 9)],
        review_comments=[review_comment(3, 1, review_id=77)],
    )
    rows = {r.id: (r.type, r.review_id, r.path, r.position) for r in load.read_dump(spark, root).comments.collect()}
    assert rows == {1: ("issue", None, None, None), 3: ("review", 77, "a.py", 1)}


def test_last_duplicate_wins_and_first_names_users(spark, tmp_path):
    root = write(
        tmp_path / "d",
        prs=[pr(1, title="old"), pr(2), pr(1, title="new", merged=True, merged_at=at(9), commits=None)],
        reviews=[review(1, 1, user(2, "bob")), review(2, 1, user(2, "bobby", type="Bot")), review(3, 2, user(1, "alicia"))],
    )
    tables = load.read_dump(spark, root)
    row = tables.pull_requests.filter("number = 1").first()
    assert (row.title, row.merged, row.commits, row.additions) == ("new", True, 0, 0)
    assert {(r.id, r.user_login, r.user_type) for r in tables.reviews.collect()} >= {(1, "bob", "User"), (2, "bob", "User")}
    # The review named user 1 first, so the author's name changes too.
    assert row.user_login == "alicia"
    # Both are kept: the author is matched by the payload's own login.
    assert ids(tables.pull_requests, "number") == [1, 2]


def test_head_takes_the_base_repository(spark, tmp_path):
    row = load.read_dump(spark, write(tmp_path / "d", prs=[pr(1)])).pull_requests.first()
    assert (row.head.repo_id, row.base.repo_id, row.repo_id, row.head.user_id) == (10, 10, 10, 1)


def test_only_pull_requests_the_subject_acted_on(spark, tmp_path):
    base = "https://api.example.org/repos/org/repo/issues"
    others = [pr(n, BOB) for n in range(1, 9)]
    root = write(
        tmp_path / "d",
        prs=[pr(20), *others],
        reviews=[review(1, 1, ALICE), review(2, 8, CAROL)],
        commits=[commit("a", 2, ALICE), commit("b", 7, BOB, committer=ALICE)],
        issue_comments=[issue_comment(3, 3, ALICE)],
        review_comments=[review_comment(4, 4, ALICE)],
        timeline=[event(5, f"{base}/5/timeline", ALICE)],
        files=[changed(6), changed(5)],
    )
    tables = load.read_dump(spark, root)
    # Being only the committer (7) or having no part (6, 8) is not acting.
    assert ids(tables.pull_requests, "number") == [1, 2, 3, 4, 5, 20]
    assert ids(tables.reviews) == [1]
    assert ids(tables.files, "number") == [5]
    # Users seen on dropped rows remain.
    assert "carol" in {r.login for r in tables.users.collect()}
    everything = load.read_dump(spark, root, prune=False)
    assert everything.pull_requests.count() == 9


def test_same_number_in_two_repositories(spark, tmp_path):
    other = {**REPO, "id": 11, "name": "two", "full_name": "org/two"}
    url = "https://api.example.org/repos/org/two/pulls/1"
    root = write(
        tmp_path / "d",
        prs=[pr(1), pr(1, repo=other, title="other")],
        reviews=[review(1, 1), {**review(2, 1), "pull_request_url": url}],
    )
    plain = load.read_dump(spark, root)
    assert (plain.pull_requests.count(), plain.reviews.count()) == (1, 2)
    by_repo = load.read_dump(spark, root, key="repo")
    assert by_repo.pull_requests.count() == 2
    assert {(r.id, r.repo_key) for r in by_repo.reviews.collect()} == {(1, "org/repo"), (2, "org/two")}


def test_several_dumps_at_once(spark, tmp_path):
    write(tmp_path / "a", prs=[pr(1), pr(2, BOB)], reviews=[review(1, 1)])
    later = {**MANIFEST, "user": "bob", "from": "2026-01-05T00:00:00Z"}
    write(tmp_path / "b", manifest=later, prs=[pr(1, BOB, at(6)), pr(2, BOB, at(2))])
    tables = load.read_dumps(spark, str(tmp_path / "*"))

    def name(row):
        assert row.dump_id.startswith("file:") and str(tmp_path) in row.dump_id
        return row.dump_id.rsplit("/", 1)[-1]

    assert sorted((name(r), r.number) for r in tables.pull_requests.collect()) == [("a", 1), ("b", 1)]
    header = {(name(r), r.user_login, r.table): r.rows for r in report_header(tables).collect()}
    assert header["a", "alice", "reviews"] == 1
    assert header["b", "bob", "reviews"] == 0
    assert read_manifests(spark, str(tmp_path / "*")).count() == 2


# --- failures ---

BAD = {
    "line that is not JSON": {"reviews": [review(1, 1), "{oops"]},
    "null user on a review": {"reviews": [review(1, 1), review(2, 1, None)]},
    "user without id on a comment": {"issue_comments": [issue_comment(1, 1, user(None, "x"))]},
    "unknown user type": {"reviews": [review(1, 1), review(2, 1, user(8, "x", type="Alien"))]},
    "no submission time": {"reviews": [review(1, 1), review(2, 1, when=None)]},
    "malformed time": {"commits": [commit("a", 1, when="yesterday")]},
    "no number in the URL": {"reviews": [review(1, 1), review(2, "x")]},
    "unknown state of a pull request": {"prs": [pr(1), pr(2, state="limbo")]},
}


@pytest.mark.parametrize("name", BAD)
def test_bad_rows_fail_or_are_set_aside(spark, tmp_path, name):
    root = write(tmp_path / "d", **({"prs": [pr(1)]} | BAD[name]))
    with pytest.raises((PySparkException, Py4JJavaError)):
        tables = load.read_dump(spark, root)
        dataset_summary(tables).collect()
    kept = load.read_dump(spark, root, on_error="quarantine")
    assert kept.pull_requests.count() == 1
    aside = kept.quarantine.collect()
    assert len(aside) == 1
    assert aside[0].record and aside[0].reason and aside[0].dump_id == str(tmp_path / "d")


# --- sinks ---


def bundle(number, **more):
    return {"pull_request": pr(number), "reviews": [review(number * 10, number)], **more}


def test_bundles_round_trip(spark, tmp_path):
    rows = [
        bundle(1, commits=[commit("b", None), commit("a", None)], files=[changed(None)], review_comments=[review_comment(5, 1)]),
        bundle(2, commits=None, files=[]),
    ]
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    bundles = text.select(F.from_json("value", schemas.BUNDLE).alias("b")).select("b.*")
    root = str(tmp_path / "d")
    sinks.write_manifest(spark, root, MANIFEST)
    sinks.append_bundles(bundles, root)
    commits = dump.scan(spark, root, "commits").select("sha", "pull_request_number", "idx").collect()
    assert sorted(map(tuple, commits)) == [("a", 1, 1), ("b", 1, 0)]
    tables = load.read_dump(spark, root)
    assert (tables.pull_requests.count(), tables.reviews.count(), tables.files.count()) == (2, 2, 1)
    assert ids(tables.comments) == [5]
    # A repeated fetch repeats children, but not pull requests.
    sinks.append_bundles(bundles, root)
    again = load.read_dump(spark, root)
    assert (again.pull_requests.count(), again.reviews.count()) == (2, 4)
    assert load.read_dump(spark, root, dedup_children=True).reviews.count() == 2


def test_canonical_tables_round_trip(spark, tmp_path):
    tables = load.read_dump(spark, write(tmp_path / "d", prs=[pr(1)], reviews=[review(1, 1)]))
    tables.write(str(tmp_path / "landed"))
    back = Tables.read(spark, str(tmp_path / "landed"))
    assert back.reviews.drop("line_ord").collect() == tables.reviews.drop("line_ord").collect()
    assert back.quarantine is None


# --- nothing is lost without a word -------------------------------------------------------


@pytest.mark.parametrize("bound", ["from", "to"])
def test_an_unreadable_window_is_refused(spark, tmp_path, bound):
    root = write(tmp_path / "d", manifest={**MANIFEST, bound: "not a date"}, prs=[pr(1)])
    with pytest.raises(ManifestError):
        load.read_dump(spark, root)
    with pytest.raises(Exception, match="unusable manifest"):
        load.read_dumps(spark, str(tmp_path / "*")).pull_requests.count()


def test_an_empty_committer_falls_back_to_the_author(spark, tmp_path):
    commits = [commit("a", 1), {**commit("b", 1), "committer": {}}, {**commit("c", 1), "committer": None}]
    tables = load.read_dump(spark, write(tmp_path / "d", prs=[pr(1)], commits=commits))
    assert {(r.sha, r.committer_id is not None) for r in tables.commits.collect()} == {("a", True), ("b", True), ("c", True)}


@pytest.mark.parametrize("side", ["head", "base"])
def test_a_branch_without_a_user_is_refused(spark, tmp_path, side):
    bad = pr(1)
    bad[side] = {**bad[side], "user": None}
    with pytest.raises(Exception, match="no valid user of a branch"):
        load.read_dump(spark, write(tmp_path / "d", prs=[bad])).pull_requests.count()


def test_dumps_in_folders_of_the_same_name_stay_apart(spark, tmp_path):
    for top in ("x", "y"):
        write(tmp_path / top / "canonical" / "dump", prs=[pr(1)], commits=[commit("a", 1)])
    tables = load.read_dumps(spark, str(tmp_path / "*" / "canonical" / "dump"))
    assert tables.commits.count() == 2 and tables.pull_requests.count() == 2
    assert tables.commits.select("dump_id").distinct().count() == 2


def test_copies_of_children_keep_the_last_of_each_id_and_type(spark, tmp_path):
    root = write(
        tmp_path / "d", prs=[pr(1)], issue_comments=[issue_comment(7, 1), issue_comment(7, 1), issue_comment(8, 1)],
        review_comments=[review_comment(7, 1)],
    )
    tables = load.read_dump(spark, root, dedup_children=True)
    assert sorted((r.id, r.type) for r in tables.comments.collect()) == [(7, "issue"), (7, "review"), (8, "issue")]


# --- layouts and input order --------------------------------------------------------------


def raw_prs(spark, *titles, number=1):
    text = spark.createDataFrame([(i, json.dumps(pr(number, title=t))) for i, t in enumerate(titles)], "i int, value string")
    rows = text.repartitionByRange(min(4, len(titles)), "i").sortWithinPartitions("i")
    return rows.select(F.from_json("value", schemas.RAW["pull_requests"]).alias("p")).select("p.*")


def titles(spark, root):
    rows = dump.scan(spark, root, "pull_requests").select("title", "line_ord").collect()
    return [r.title for r in sorted(rows, key=lambda r: tuple(-1 if v is None else v for v in r.line_ord))]


def test_appends_to_a_plain_file_keep_it_one_file(spark, tmp_path):
    root = write(tmp_path / "d", prs=[pr(1, title="old"), pr(2, title="two\r\nlines")])
    path = tmp_path / "d" / "canonical" / "pull_requests.jsonl"
    path.write_text(path.read_text().rstrip("\n"))  # a last line without an end
    more = [f"t{i}" for i in range(20)]
    sinks.append_tables({"pull_requests": raw_prs(spark, *more)}, root)
    sinks.append_tables({"pull_requests": raw_prs(spark, "last")}, root)
    lines = [json.loads(line) for line in path.read_text().splitlines()]
    assert [line["title"] for line in lines] == ["old", "two\r\nlines", *more, "last"]
    assert lines[0]["unknown_field"] == [1, 2] and "_line" not in lines[-1]
    assert sorted(os.listdir(path.parent)) == [".pull_requests.jsonl.crc", "pull_requests.jsonl"]
    assert titles(spark, root) == [line["title"] for line in lines]
    assert {r.number: r.title for r in load.read_dump(spark, root, prune=False).pull_requests.collect()}[1] == "last"


def test_a_dump_can_be_written_as_plain_files(spark, tmp_path):
    root = str(tmp_path / "d")
    sinks.write_manifest(spark, root, MANIFEST)
    sinks.append_tables({"pull_requests": raw_prs(spark, "a", "b", "c"), "reviews": spark.createDataFrame([], schemas.RAW["reviews"])}, root, "file")
    assert json.loads((tmp_path / "d" / "dump_manifest.json").read_text()) == MANIFEST
    assert len((tmp_path / "d" / "canonical" / "pull_requests.jsonl").read_text().splitlines()) == 3
    sinks.write_manifest(spark, root, {**MANIFEST, "notes": "again"})
    assert read_manifest(spark, root).fields["notes"] == "again"
    tables = load.read_dumps(spark, str(tmp_path / "*"), prune=False)
    assert [r.title for r in tables.pull_requests.collect()] == ["c"] and tables.reviews.count() == 0


def test_layouts_do_not_mix(spark, tmp_path):
    root = write(tmp_path / "d", prs=[pr(1)])
    with pytest.raises(FileExistsError):
        sinks.append_tables({"pull_requests": raw_prs(spark, "x")}, root, "folder")
    other = str(tmp_path / "e")
    sinks.append_tables({"pull_requests": raw_prs(spark, "x")}, other)
    with pytest.raises(FileExistsError):
        sinks.append_tables({"pull_requests": raw_prs(spark, "x")}, other, "file")
    with pytest.raises(ValueError):
        sinks.append_tables({}, other, "tape")


def test_order_survives_copying_a_dump_of_many_parts(spark, tmp_path):
    root = str(tmp_path / "d")
    sinks.write_manifest(spark, root, MANIFEST)
    first, second = [f"a{i:02}" for i in range(30)], [f"b{i:02}" for i in range(30)]
    sinks.append_tables({"pull_requests": raw_prs(spark, *first)}, root)
    sinks.append_tables({"pull_requests": raw_prs(spark, *second).limit(0)}, root)
    sinks.append_tables({"pull_requests": raw_prs(spark, *second)}, root)
    assert titles(spark, root) == first + second
    # A copy with other names and times, newest first, and without what is hidden.
    source, target = tmp_path / "d" / "canonical" / "pull_requests.jsonl", tmp_path / "c" / "canonical" / "pull_requests.jsonl"
    os.makedirs(target)
    parts = sorted(p for p in source.iterdir() if p.name.startswith("part-"))
    assert len(parts) >= 8
    for i, part in enumerate(sorted(parts, key=lambda p: -p.stat().st_mtime)):
        copy = target / f"part-{i}.json"
        copy.write_text(part.read_text())
        os.utime(copy, (1000 - i, 1000 - i))
    (tmp_path / "c" / "dump_manifest.json").write_text(json.dumps(MANIFEST))
    copied = str(tmp_path / "c")
    assert titles(spark, copied) == first + second
    assert [r.title for r in load.read_dump(spark, copied, prune=False).pull_requests.collect()] == ["b29"]
    sinks.append_tables({"pull_requests": raw_prs(spark, "z")}, copied)
    assert titles(spark, copied)[-1] == "z"


def test_parts_of_another_writer_come_before_numbered_ones(spark, tmp_path):
    folder = tmp_path / "d" / "canonical" / "pull_requests.jsonl"
    os.makedirs(folder)
    (folder / "part-z.json").write_text(json.dumps(pr(1, title="foreign")) + "\n")
    sinks.append_tables({"pull_requests": raw_prs(spark, "own")}, str(tmp_path / "d"))
    assert titles(spark, str(tmp_path / "d")) == ["foreign", "own"]


def test_compressed_dump_loads_alike_and_takes_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_COMPRESSED_LINES", 20)
    sizes, names = {}, [f"a{i:03}" for i in range(300)]
    for kind, options in (("plain", {}), ("short", {"compression": "gzip"})):
        root = str(tmp_path / kind)
        sinks.append_tables({"pull_requests": raw_prs(spark, *names)}, root, **options)
        sinks.append_tables({"pull_requests": raw_prs(spark, "last")}, root, **options)
        assert titles(spark, root) == [*names, "last"]
        parts = [p for p in (tmp_path / kind / "canonical" / "pull_requests.jsonl").iterdir() if p.name.startswith("part-")]
        sizes[kind] = sum(p.stat().st_size for p in parts)
        if options:
            assert len(parts) >= 15 and all(p.name.endswith(".json.gz") for p in parts)
    assert sizes["short"] * 5 < sizes["plain"]
    root = str(tmp_path / "file")
    with pytest.raises(ValueError):
        sinks.append_tables({"pull_requests": raw_prs(spark, "x")}, root, "file", "gzip")
