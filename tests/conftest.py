"""Shared session and small hand-made tables."""

from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.dirname(os.path.abspath(__file__))):
    if path not in sys.path:
        sys.path.insert(0, path)

from mergelens.operators.tables import Tables  # noqa: E402
from mergelens.session import local_session  # noqa: E402

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=4, app="mergelens-tests")
    yield session
    session.stop()


def hour(offset):
    return None if offset is None else BASE + timedelta(hours=offset)


_KEY = "dump_id string, repo_key string, number long"
_SCHEMAS = {
    "pull_requests": f"{_KEY}, user_login string, user_type string, created_at timestamp, merged_at timestamp, "
    "closed_at timestamp, merged boolean, line_ord long",
    "reviews": f"{_KEY}, id long, user_login string, user_type string, state string, submitted_at timestamp, line_ord long",
    "commits": f"{_KEY}, sha string, author_login string, date timestamp, line_ord long",
    "comments": f"{_KEY}, id long, user_login string, user_type string, type string, review_id long, path string, "
    "created_at timestamp, line_ord long",
    "files": f"{_KEY}, filename string",
    "timeline": f"{_KEY}, id long, event string, actor_login string, actor_type string, created_at timestamp, line_ord long",
}


def kind(login):
    return "Bot" if login.endswith("bot") else "User"


def make_tables(spark, prs=(), reviews=(), commits=(), comments=(), files=(), timeline=()):
    """Tables from short tuples; times are hours after 2026-01-01.

    prs: (number, author, created, merged[, closed]); reviews: (id, pr, user, at, state);
    commits: (pr, user, at); comments: (id, pr, user, at, type, review_id, path);
    files: (pr, name); timeline: (id, pr, actor, at, event).
    """
    rows = {
        "pull_requests": [
            ("d", "", p[0], p[1], kind(p[1]), hour(p[2]), hour(p[3]), hour(p[4] if len(p) > 4 else p[3]), p[3] is not None, i)
            for i, p in enumerate(prs)
        ],
        "reviews": [("d", "", r[1], r[0], r[2], kind(r[2]), r[4], hour(r[3]), i) for i, r in enumerate(reviews)],
        "commits": [("d", "", c[0], f"sha{i}", c[1], hour(c[2]), i) for i, c in enumerate(commits)],
        "comments": [
            ("d", "", c[1], c[0], c[2], kind(c[2]), c[4], c[5], c[6], hour(c[3]), i) for i, c in enumerate(comments)
        ],
        "files": [("d", "", f[0], f[1]) for f in files],
        "timeline": [("d", "", t[1], t[0], t[4], t[2], kind(t[2]), hour(t[3]), i) for i, t in enumerate(timeline)],
    }
    return Tables(**{name: spark.createDataFrame(rows[name], _SCHEMAS[name]) for name in _SCHEMAS})


def make_subjects(spark, *logins, start=0, end=240):
    rows = [("d", login, hour(start), hour(end)) for login in logins]
    return spark.createDataFrame(rows, "dump_id string, user_login string, start_date timestamp, end_date timestamp")
