"""Declared schemas of the raw payloads; fields outside them are ignored."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _TEXT, _FLAG = T.LongType(), T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


USER = _struct(id=_LONG, login=_TEXT, type=_TEXT, avatar_url=_TEXT)
LOGIN = _struct(login=_TEXT)
REPOSITORY = _struct(id=_LONG, name=_TEXT, full_name=_TEXT, owner=USER)
BASE = _struct(label=_TEXT, ref=_TEXT, sha=_TEXT, user=USER, repo=REPOSITORY)
HEAD = _struct(label=_TEXT, ref=_TEXT, sha=_TEXT, user=USER)

PULL_REQUEST = _struct(
    id=_LONG, number=_LONG, title=_TEXT, body=_TEXT, state=_TEXT, user=USER,
    created_at=_TEXT, updated_at=_TEXT, closed_at=_TEXT, merged_at=_TEXT,
    merged=_FLAG, merge_commit_sha=_TEXT, base=BASE, head=HEAD,
    commits=_LONG, additions=_LONG, deletions=_LONG, changed_files=_LONG,
    merged_by=USER, comments=_LONG, review_comments=_LONG,
)
REVIEW = _struct(
    id=_LONG, user=USER, body=_TEXT, state=_TEXT, submitted_at=_TEXT, pull_request_url=_TEXT
)
_COMMIT_META = _struct(message=_TEXT, author=_struct(date=_TEXT))
COMMIT = _struct(
    sha=_TEXT, commit=_COMMIT_META, author=USER, committer=USER,
    pull_request_number=_LONG, idx=_LONG, repository=_TEXT,
)
REVIEW_COMMENT = _struct(
    id=_LONG, user=USER, body=_TEXT, created_at=_TEXT, updated_at=_TEXT,
    pull_request_url=_TEXT, pull_request_review_id=_LONG, in_reply_to_id=_LONG,
    path=_TEXT, position=_LONG,
)
ISSUE_COMMENT = _struct(
    id=_LONG, user=USER, body=_TEXT, created_at=_TEXT, updated_at=_TEXT, issue_url=_TEXT
)
TIMELINE_EVENT = _struct(
    id=_LONG, node_id=_TEXT, url=_TEXT, event=_TEXT, actor=USER, created_at=_TEXT,
    commit_id=_TEXT, commit_url=_TEXT, comment_id=_LONG, state=_TEXT, html_url=_TEXT,
    pull_request_number=_LONG, repository=_TEXT,
)
FILE = _struct(
    sha=_TEXT, filename=_TEXT, additions=_LONG, deletions=_LONG, changes=_LONG,
    status=_TEXT, pull_request_number=_LONG, repository=_TEXT,
)

RAW = {
    "pull_requests": PULL_REQUEST,
    "reviews": REVIEW,
    "review_comments": REVIEW_COMMENT,
    "issue_comments": ISSUE_COMMENT,
    "commits": COMMIT,
    "files": FILE,
    "timeline": TIMELINE_EVENT,
}

# One nested record per pull request, as a fetch job hands it over.
BUNDLE = _struct(
    pull_request=PULL_REQUEST,
    timeline=T.ArrayType(TIMELINE_EVENT),
    reviews=T.ArrayType(REVIEW),
    review_comments=T.ArrayType(REVIEW_COMMENT),
    issue_comments=T.ArrayType(ISSUE_COMMENT),
    commits=T.ArrayType(COMMIT),
    files=T.ArrayType(FILE),
)

LISTING = _struct(
    number=_LONG, updated_at=_TEXT, user=USER,
    requested_reviewers=T.ArrayType(LOGIN), assignees=T.ArrayType(LOGIN),
)

# "from" and "to" are the manifest's own field names.
MANIFEST = T.StructType(
    [
        T.StructField("provider", _TEXT),
        T.StructField("api_version", _TEXT),
        T.StructField("user", _TEXT),
        T.StructField("from", _TEXT),
        T.StructField("to", _TEXT),
        T.StructField("repositories", T.ArrayType(_TEXT)),
        T.StructField("generated_at", _TEXT),
        T.StructField("notes", _TEXT),
    ]
)
