"""The registered queries as independent SQL over the same star tables (DuckDB)."""

from __future__ import annotations

# Written out here and not imported, so that a change of the engine's values shows.
_NAMES = {
    "pr_merge_effectiveness": "PR Merge Effectiveness",
    "review_leverage": "Review Leverage",
    "pr_throughput": "PR Throughput",
    "cycle_time": "Cycle Time",
    "review_iterations": "Review Iterations",
    "time_to_first_review": "Time to First Review",
    "slow_review_response": "Slow Review Response",
}
_WITHOUT_WINDOW = (
    "acted_prs", "subject_children", "pr_children", "review_comments_by_review", "review_with_pr", "is_change_request",
    "event_after_review", "merged_after_review", "next_author_commit", "next_review", "effective_change_request",
    "review_path_overlap", "first_external_review", "pr_interactions", "interaction_breakdown", "pr_activity_seq",
    "ordered_pr_numbers_open_period",
)
_RATED = {
    "pr_throughput": ("merge_ratio", ">= 0.9", ">= 0.7", ">= 0.5"),
    "cycle_time": ("median_hours", "<= 1", "<= 3", "<= 7"),
    "pr_merge_effectiveness": ("average_back_and_forth", "<= 1", "<= 2", "<= 4"),
    "review_leverage": ("effectiveness_percentage", ">= 80", ">= 60", ">= 30"),
    "review_iterations": ("average_iterations", "<= 1", "<= 2", "<= 4"),
    "time_to_first_review": ("median_hours", "<= 1", "<= 6", "<= 24"),
    "slow_review_response": ("median_hours", "<= 2", "<= 12", "<= 48"),
}

_BASE = """
WITH bounds AS (
  SELECT CAST(epoch(TIMESTAMP '1996-01-01') AS BIGINT) // 3600 AS ws,
         CAST(epoch(TIMESTAMP '2000-12-31') AS BIGINT) // 3600 AS we
), all_prs AS (
  SELECT o_orderkey AS number, o_custkey % 97 AS author_id, o_orderkey % 5 AS repo_id,
         'user_' || (o_custkey % 97) AS author, o_orderstatus = 'F' AS merged,
         CAST(epoch(o_orderdate) AS BIGINT) // 3600 AS created_h,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(epoch(o_orderdate) AS BIGINT) // 3600 + 24 + (o_orderkey * 37) % 400 END AS merged_h,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(epoch(o_orderdate) AS BIGINT) // 3600 + 24 + (o_orderkey * 37) % 400
              WHEN o_orderstatus = 'P'
              THEN CAST(epoch(o_orderdate) AS BIGINT) // 3600 + 200 END AS closed_h
  FROM orders
), act AS (
  SELECT l_orderkey * 100 + row_number() OVER (
           PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id,
         p.number, p.author_id, p.author, p.repo_id,
         (l_suppkey * 7 + l_linenumber) % 97 AS actor_id,
         'user_' || ((l_suppkey * 7 + l_linenumber) % 97) AS actor,
         p.created_h + (l_partkey * 13 + l_linenumber * 5) % 120 AS ts_h,
         CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part,
         l_returnflag AS flag, l_linestatus AS status
  FROM lineitem JOIN all_prs p ON l_orderkey = p.number
), all_reviews AS (
  SELECT *, CASE flag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'changes_requested' ELSE 'commented' END AS state
  FROM act WHERE status = 'F'
), all_commits AS (
  SELECT *, CASE WHEN line <= 5 THEN author_id ELSE actor_id END AS user_id,
         CASE WHEN line <= 5 THEN author ELSE actor END AS login, 'sha' || id AS sha
  FROM act WHERE status = 'O' AND flag = 'N'
), first_reviews AS (
  SELECT number, min(id) AS first_review FROM all_reviews GROUP BY number
), all_comments AS (
  SELECT a.*, CASE WHEN line % 2 = 1 THEN first_review END AS review_id,
         CASE WHEN line % 2 = 1 AND first_review IS NOT NULL THEN 'review' ELSE 'issue' END AS type,
         CASE WHEN line % 2 = 1 AND first_review IS NOT NULL THEN 'src/f' || (part % 7) END AS path
  FROM act a LEFT JOIN first_reviews USING (number) WHERE status = 'O' AND flag = 'R'
), once_timeline AS (
  SELECT * FROM act WHERE status = 'O' AND flag = 'A'
), all_timeline AS (
  SELECT *, CASE WHEN line <= 2 THEN 'reviewed' WHEN line <= 4 THEN 'commented'
                 WHEN line = 5 THEN 'merged' ELSE 'labeled' END AS event
  FROM (SELECT * FROM once_timeline
        UNION ALL SELECT * REPLACE (id + 50 AS id) FROM once_timeline WHERE line = 3)
), all_files AS (
  SELECT DISTINCT number, 'src/f' || ((part + line) % 7) AS filename FROM act
), prs AS (
  SELECT p.* FROM all_prs p, bounds WHERE created_h BETWEEN ws AND we
), reviews AS (
  SELECT r.* FROM all_reviews r, bounds WHERE ts_h BETWEEN ws AND we AND number IN (SELECT number FROM prs)
), commits AS (
  SELECT r.* FROM all_commits r, bounds WHERE ts_h BETWEEN ws AND we AND number IN (SELECT number FROM prs)
), comments AS (
  SELECT r.* FROM all_comments r, bounds WHERE ts_h BETWEEN ws AND we AND number IN (SELECT number FROM prs)
), timeline AS (
  SELECT r.* FROM all_timeline r, bounds WHERE ts_h BETWEEN ws AND we AND number IN (SELECT number FROM prs)
), files AS (
  SELECT * FROM all_files WHERE number IN (SELECT number FROM prs)
), subjects AS (
  SELECT user_login, CASE WHEN u % 4 <> 0 THEN ws + (u % 5) * 2000 END AS ps,
         CASE WHEN u % 6 <> 1 THEN we - (u % 7) * 1500 END AS pe
  FROM (SELECT user_login, CAST(substr(user_login, 6) AS BIGINT) AS u
        FROM (SELECT author AS user_login FROM prs UNION SELECT actor FROM reviews)), bounds
)"""

_RAW = """, raw_prs AS (
  SELECT p.*, copy, number + CASE WHEN copy = 2 THEN 1000000000000 ELSE 0 END AS ord,
         'PR ' || number || CASE WHEN copy = 2 THEN ' again' ELSE '' END AS title,
         'user_' || author_id || CASE WHEN number % 11 = 0 THEN '_old' ELSE '' END AS raw_author
  FROM all_prs p, (VALUES (1), (2)) c(copy) WHERE copy = 1 OR number % 50 = 0
), raw_reviews AS (
  SELECT *, CASE WHEN line = 7 THEN 'commented' ELSE state END AS raw_state,
         actor || CASE WHEN id % 11 = 0 THEN '_old' ELSE '' END AS raw_login FROM all_reviews
), raw_commits AS (
  SELECT *, CASE WHEN id % 13 <> 0 THEN 'fix' ELSE '' END AS message,
         login || CASE WHEN id % 11 = 0 THEN '_old' ELSE '' END AS raw_login
  FROM all_commits
), seen_commits AS (
  SELECT c.* FROM raw_commits c, bounds
  WHERE id % 17 <> 0 AND ts_h BETWEEN ws AND we AND id % 23 <> 0
    AND number IN (SELECT number FROM prs) AND id % 19 <> 0
), raw_comments AS (
  SELECT *, actor || CASE WHEN id % 11 = 0 THEN '_old' ELSE '' END AS raw_login FROM all_comments
), seen_timeline AS (
  SELECT t.*, actor || CASE WHEN id % 11 = 0 THEN '_old' ELSE '' END AS raw_login
  FROM all_timeline t, bounds
  WHERE line <> 7 AND id % 29 <> 0 AND id % 31 <> 0 AND ts_h BETWEEN ws AND we
    AND number IN (SELECT number FROM prs)
), seen_reviews AS (
  SELECT r.* FROM raw_reviews r, bounds WHERE ts_h BETWEEN ws AND we AND number IN (SELECT number FROM prs)
), seen_comments AS (
  SELECT r.* FROM raw_comments r, bounds WHERE ts_h BETWEEN ws AND we AND number IN (SELECT number FROM prs)
), child_mentions AS (
  SELECT actor_id AS user_id, raw_login AS login, 0 AS rank, id AS ord, 0 AS slot FROM seen_reviews
  UNION ALL SELECT user_id, raw_login, 1, id, 0 FROM seen_commits
  UNION ALL SELECT CASE WHEN id % 3 <> 0 THEN actor_id ELSE user_id END,
                   CASE WHEN id % 3 <> 0 THEN actor ELSE raw_login END, 1, id, 1 FROM seen_commits
  UNION ALL SELECT actor_id, raw_login, CASE WHEN type = 'review' THEN 2 ELSE 3 END, id, 0 FROM seen_comments
  UNION ALL SELECT actor_id, raw_login, 4, id, 0 FROM seen_timeline
), raw_kept AS (
  SELECT p.*, 'PR ' || number || CASE WHEN number % 50 = 0 THEN ' again' ELSE '' END AS title,
         'user_' || author_id || CASE WHEN number % 11 = 0 THEN '_old' ELSE '' END AS raw_author
  FROM prs p
), mentions AS (
  SELECT * FROM child_mentions
  UNION ALL SELECT repo_id + 900, 'org', 5, number, 0 FROM raw_kept
  UNION ALL SELECT repo_id + 200, 'user_' || (repo_id + 200), 5, number, 1 FROM raw_kept
  UNION ALL SELECT author_id, 'user_' || author_id, 5, number, 2 FROM raw_kept
  UNION ALL SELECT (author_id + 1) % 97, 'user_' || ((author_id + 1) % 97), 5, number, 3 FROM raw_kept WHERE merged
  UNION ALL SELECT author_id, raw_author, 5, number, 4 FROM raw_kept
), ranked_mentions AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank, ord, slot) AS rn FROM mentions
), people AS (
  SELECT user_id AS id, login,
         CASE WHEN user_id >= 900 THEN 'Organization' WHEN user_id % 20 = 0 THEN 'Bot' ELSE 'User' END AS type
  FROM ranked_mentions WHERE rn = 1
), usable_commits AS (
  SELECT * FROM seen_commits WHERE message <> ''
), acted AS (
  SELECT raw_author AS login, number FROM raw_kept
  UNION SELECT u.login, number FROM seen_reviews JOIN people u ON u.id = actor_id
  UNION SELECT u.login, number FROM usable_commits JOIN people u ON u.id = user_id
  UNION SELECT u.login, number FROM seen_comments JOIN people u ON u.id = actor_id
  UNION SELECT u.login, number FROM seen_timeline JOIN people u ON u.id = actor_id
), kept AS (
  SELECT number FROM acted WHERE login = 'user_7'
)"""

# Reviews with their marks, the next author commit and the next review.
_FOLLOWED = """, marks AS (
  SELECT r.id, r.state = 'changes_requested' OR EXISTS (SELECT 1 FROM comments c WHERE c.review_id = r.id)
               AS is_change_request,
         EXISTS (SELECT 1 FROM comments c WHERE c.review_id = r.id AND c.path <> '') AS has_paths,
         EXISTS (SELECT 1 FROM comments c JOIN files f ON f.number = r.number AND f.filename = c.path
                 WHERE c.review_id = r.id) AS on_path
  FROM reviews r
), followed AS (
  SELECT r.id, r.number, r.actor, r.ts_h, r.state, p.author AS pr_author, p.merged, p.merged_h, p.closed_h, p.created_h,
         (SELECT min(c.ts_h) FROM commits c WHERE c.number = r.number AND c.number <> 0
            AND c.login = p.author AND c.ts_h > r.ts_h) AS next_commit,
         (SELECT min(o.ts_h) FROM reviews o WHERE o.number = r.number AND o.ts_h > r.ts_h) AS next_review
  FROM reviews r LEFT JOIN prs p USING (number)
), facts AS (
  SELECT f.*, m.is_change_request,
         m.is_change_request AND f.merged AND EXISTS (
           SELECT 1 FROM commits c
           WHERE c.number = f.number AND c.number <> 0 AND c.login = f.pr_author AND c.ts_h > f.ts_h
             AND c.ts_h <= f.ts_h + 72 AND c.ts_h <= coalesce(f.merged_h, f.closed_h, f.ts_h + 72)
             AND NOT EXISTS (SELECT 1 FROM reviews o
                             WHERE o.number = f.number AND o.ts_h > f.ts_h AND o.ts_h <= c.ts_h))
           AND (NOT m.has_paths OR m.on_path) AS effective,
         EXISTS (SELECT 1 FROM timeline t WHERE t.number = f.number AND t.ts_h > f.ts_h) AS updated_after,
         f.merged AND (f.merged_h >= f.ts_h
           OR EXISTS (SELECT 1 FROM timeline t
                      WHERE t.number = f.number AND t.event = 'merged' AND t.ts_h >= f.ts_h)) AS merged_after
  FROM followed f JOIN marks m USING (id)
)"""

_INTERACTIONS = """, interactions AS (
  SELECT x.number, x.actor, x.kind, x.at_h, p.merged
  FROM (
    SELECT number, actor, actor_id, 'review' AS kind, ts_h AS at_h FROM reviews
    UNION ALL SELECT number, actor, actor_id, 'comment_' || type, ts_h FROM comments WHERE number <> 0
    UNION ALL SELECT DISTINCT number, actor, actor_id, 'timeline', ts_h FROM timeline
              WHERE event IN ('reviewed', 'commented')
  ) x JOIN prs p USING (number)
  WHERE x.actor <> p.author AND x.actor_id % 20 <> 0 AND (p.merged_h IS NULL OR x.at_h < p.merged_h)
)"""

_METRICS = (
    _FOLLOWED
    + _INTERACTIONS
    + """, opened AS (
  SELECT s.user_login, prs.* FROM prs JOIN subjects s ON author = s.user_login
  WHERE created_h BETWEEN coalesce(ps, created_h) AND coalesce(pe, created_h)
), merged_in AS (
  SELECT s.user_login, prs.*, CAST(merged_h - created_h AS DOUBLE) AS hours
  FROM prs JOIN subjects s ON author = s.user_login
  WHERE merged AND merged_h BETWEEN coalesce(ps, merged_h) AND coalesce(pe, merged_h)
), own_reviews AS (
  SELECT s.user_login, facts.* FROM facts JOIN subjects s ON actor = s.user_login
  WHERE ts_h BETWEEN coalesce(ps, ts_h) AND coalesce(pe, ts_h)
), iterations AS (
  SELECT user_login, number, created_h,
         (SELECT count(*) FROM facts f WHERE f.number = o.number AND f.is_change_request) AS iterations
  FROM opened o WHERE merged
), firsts AS (
  SELECT user_login, o.number, o.created_h,
         (SELECT min(ts_h) FROM reviews r WHERE r.number = o.number AND r.actor <> o.author) - o.created_h AS hours
  FROM opened o
), responses AS (
  SELECT o.user_login, o.number, f.id, f.next_commit - f.ts_h AS hours
  FROM opened o JOIN facts f USING (number) WHERE o.merged AND f.state = 'changes_requested'
), back_and_forth AS (
  SELECT m.user_login, m.number, m.hours, (SELECT count(*) FROM interactions i WHERE i.number = m.number) AS n
  FROM merged_in m
), pr_throughput AS (
  SELECT user_login, opened_count, merged_count,
         CASE WHEN opened_count = 0 THEN 0.0 ELSE merged_count / opened_count END AS merge_ratio
  FROM (SELECT s.user_login,
               (SELECT count(*) FROM opened o WHERE o.user_login = s.user_login) AS opened_count,
               (SELECT count(*) FROM merged_in m WHERE m.user_login = s.user_login) AS merged_count
        FROM subjects s)
), cycle_time AS (
  SELECT s.user_login, count(hours) AS merged_count, coalesce(quantile_cont(hours, 0.5), 0.0) AS median_hours,
         coalesce(quantile_cont(hours, 0.75), 0.0) AS p75_hours
  FROM subjects s LEFT JOIN merged_in m USING (user_login) GROUP BY s.user_login
), pr_merge_effectiveness AS (
  SELECT s.user_login, nullif(count(number), 0) AS merged_pr_count, avg(hours) AS average_merge_time_hours,
         avg(n) AS average_back_and_forth
  FROM subjects s LEFT JOIN back_and_forth b USING (user_login) GROUP BY s.user_login
), leverage_counts AS (
  SELECT user_login, count(*) AS total_reviews, count(*) FILTER (is_change_request) AS change_requests,
         count(*) FILTER (effective) AS effective_changes, count(*) FILTER (updated_after) AS updated_after_review,
         count(*) FILTER (merged_after) AS merged_after_review
  FROM own_reviews GROUP BY user_login
), review_leverage AS (
  SELECT s.user_login, total_reviews, change_requests, effective_changes,
         effective_changes / change_requests * 100 AS effectiveness_percentage,
         updated_after_review, merged_after_review
  FROM subjects s LEFT JOIN (SELECT * FROM leverage_counts WHERE change_requests > 0) l USING (user_login)
), review_iterations AS (
  SELECT s.user_login, count(number) AS merged_prs, coalesce(avg(iterations), 0.0) AS average_iterations
  FROM subjects s LEFT JOIN iterations USING (user_login) GROUP BY s.user_login
), time_to_first_review AS (
  SELECT s.user_login, count(hours) AS reviewed_prs,
         coalesce(quantile_cont(CAST(hours AS DOUBLE), 0.5), 0.0) AS median_hours,
         coalesce(quantile_cont(CAST(hours AS DOUBLE), 0.75), 0.0) AS p75_hours
  FROM subjects s LEFT JOIN firsts USING (user_login) GROUP BY s.user_login
), slow_review_response AS (
  SELECT s.user_login, count(hours) AS samples,
         coalesce(quantile_cont(CAST(hours AS DOUBLE), 0.5), 0.0) AS median_hours,
         coalesce(quantile_cont(CAST(hours AS DOUBLE), 0.75), 0.0) AS p75_hours
  FROM subjects s LEFT JOIN responses USING (user_login) GROUP BY s.user_login
)"""
)


def _rated(slug: str, column: str) -> str:
    _, excellent, good, neutral = _RATED[slug]
    return (
        f"CASE WHEN {column} IS NULL THEN 'unknown' WHEN {column} {excellent} THEN 'excellent' "
        f"WHEN {column} {good} THEN 'good' WHEN {column} {neutral} THEN 'neutral' ELSE 'bad' END"
    )


_SUMMARIES = {
    "pr_throughput": "printf('%d PRs opened, %d merged in window. Merge ratio: %.2f', opened_count, merged_count, merge_ratio)",
    "cycle_time": "printf('%d merged PRs. Median: %.2fh, p75: %.2fh.', merged_count, median_hours, p75_hours)",
    "pr_merge_effectiveness": "coalesce(printf('%d PRs merged, average merge time: %.1f hours, average back-and-forth: %.1f', "
    "merged_pr_count, average_merge_time_hours, average_back_and_forth), 'No PRs merged in the period.')",
    "review_leverage": "coalesce(printf('%d PRs reviewed, %d effective change requests out of %d (%.1f%%). "
    "Updated after review: %d, merged after review: %d', total_reviews, effective_changes, change_requests, "
    "effectiveness_percentage, updated_after_review, merged_after_review), 'No change requests made.')",
    "review_iterations": "printf('%d merged PRs; avg iterations: %.2f', merged_prs, average_iterations)",
    "time_to_first_review": "printf('%d PRs reviewed; median: %.2fh, p75: %.2fh', reviewed_prs, median_hours, p75_hours)",
    "slow_review_response": "printf('%d responses measured; median: %.2fh, p75: %.2fh', samples, median_hours, p75_hours)",
}


def _report(columns: dict[str, str]) -> str:
    """UNION of all metrics; column templates use {slug}, {name}, {value}, {rating}, {summary}."""
    values = {slug: rated[0] for slug, rated in _RATED.items()}
    parts = []
    for slug, name in _NAMES.items():
        filled = {
            "slug": f"'{slug}'",
            "name": f"'{name}'",
            "value": values[slug],
            "rating": _rated(slug, values[slug]),
            "summary": _SUMMARIES[slug],
        }
        listed = ", ".join(f"{text.format(**filled)} AS {alias}" for alias, text in columns.items())
        parts.append(f"SELECT user_login, {listed} FROM {slug}")
    return _BASE + _METRICS + "\n" + "\nUNION ALL ".join(parts)


_ISO = "strftime(make_timestamp({} * 3600000000), '%Y-%m-%dT%H:%M:%SZ')"
_OFFSET_ISO = "strftime(make_timestamp(({} + 2) * 3600000000), '%Y-%m-%dT%H:%M:%S.000+02:00')"
_API = "'https://api.example.org/repos/org/repo' || repo_id || "
_PULL_URL = _API + "'/pulls/' || number"
_ISSUE_URL = _API + "'/issues/' || number"


def _iso(column: str) -> str:
    return _ISO.format(column)


def _build() -> dict[str, str]:
    base, raw = _BASE, _BASE + _RAW
    followed = _BASE + _FOLLOWED
    inter = _BASE + _INTERACTIONS
    all_metrics = _BASE + _METRICS
    sql: dict[str, str] = {}

    # --- scans ---
    sql["scan_pull_requests"] = f"""{raw}
SELECT number + 1000000 AS id, number, title, CASE WHEN closed_h IS NOT NULL THEN 'closed' ELSE 'open' END AS state,
       raw_author AS login, {_iso("created_h")} AS created_at, {_iso("merged_h")} AS merged_at,
       CASE WHEN merged THEN true END AS merged, 'org/repo' || repo_id AS repo, 'head-' || number AS head_ref,
       CASE WHEN number % 4 <> 0 THEN number % 101 END AS additions
FROM raw_prs"""
    sql["scan_reviews"] = f"""{raw}
SELECT id, actor_id AS user_id, raw_login AS login,
       CASE WHEN line = 7 THEN 'DISMISSED' ELSE upper(state) END AS state,
       CASE WHEN id % 2 = 0 THEN {_iso("ts_h")} ELSE {_OFFSET_ISO.format("ts_h")} END AS submitted_at,
       {_PULL_URL} AS pull_request_url
FROM raw_reviews"""
    sql["scan_commits"] = f"""{raw}
SELECT sha, message, CASE WHEN id % 17 <> 0 THEN {_iso("ts_h")} END AS date,
       CASE WHEN id % 19 <> 0 THEN raw_login END AS author, CASE WHEN id % 3 <> 0 THEN actor END AS committer,
       CASE WHEN id % 23 <> 0 THEN number END AS pull_request_number, line - 1 AS idx
FROM raw_commits"""
    sql["scan_review_comments"] = f"""{raw}
SELECT id, raw_login AS login, 'inline' AS body, {_iso("ts_h")} AS created_at, {_iso("(ts_h + 1)")} AS updated_at,
       {_PULL_URL} AS pull_request_url, review_id AS pull_request_review_id, path, line AS position
FROM raw_comments WHERE type = 'review'"""
    sql["scan_issue_comments"] = f"""{raw}
SELECT id, raw_login AS login, 'thread' AS body, {_iso("ts_h")} AS created_at, {_ISSUE_URL} AS issue_url
FROM raw_comments WHERE type = 'issue'"""
    sql["scan_timeline"] = f"""{base}
SELECT id, CASE WHEN line = 7 THEN {_API} '/issues/events/' || id ELSE {_ISSUE_URL} || '/timeline/' END AS url, event,
       CASE WHEN id % 29 <> 0 THEN actor || CASE WHEN id % 11 = 0 THEN '_old' ELSE '' END END AS actor,
       CASE WHEN id % 31 <> 0 THEN {_iso("ts_h")} END AS created_at
FROM all_timeline"""
    sql["scan_files"] = f"""{base}
SELECT 'blob' || number || filename AS sha, filename, number % 10 AS additions, number % 7 AS deletions,
       number % 10 + number % 7 AS changes, 'modified' AS status, number AS pull_request_number
FROM all_files"""
    sql["explode_bundle"] = f"""{base}
SELECT 'pull_requests' AS "table", CAST(number + 1000000 AS VARCHAR) AS item, number, CAST(NULL AS BIGINT) AS idx
FROM all_prs
UNION ALL SELECT 'commits', sha, number, row_number() OVER (PARTITION BY number ORDER BY id) - 1
FROM all_commits WHERE id % 23 <> 0
UNION ALL SELECT 'files', filename, number, NULL FROM all_files
UNION ALL SELECT 'reviews', CAST(id AS VARCHAR), NULL, NULL FROM all_reviews
UNION ALL SELECT type || '_comments', CAST(id AS VARCHAR), NULL, NULL FROM all_comments
UNION ALL SELECT 'timeline', CAST(id AS VARCHAR), NULL, NULL FROM all_timeline WHERE line <> 7"""
    sql["listing_window"] = f"""{base}
SELECT number, coalesce(merged_h, created_h + number % 240) AS updated_h FROM all_prs, bounds
WHERE coalesce(merged_h, created_h + number % 240) BETWEEN ws AND we"""
    sql["candidate_prs"] = f"""{base}
SELECT user_login, number FROM (
  SELECT author AS user_login, number FROM all_prs UNION SELECT actor, number FROM act WHERE line IN (6, 7)
) WHERE user_login IN (SELECT actor FROM act)"""

    # --- fields ---
    sql["parse_iso_ts"] = f"""{base}
SELECT id, ts_h * 3600000000 AS micros,
       strftime(make_timestamp(ts_h * 3600000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS text, true AS malformed_is_null
FROM all_reviews"""
    sql["pr_number_from_url"] = f"""{base}
SELECT id, number, 'org/repo' || repo_id AS repo FROM all_reviews
UNION ALL SELECT id, number, 'org/repo' || repo_id FROM all_comments"""
    sql["timeline_pr_number"] = f"{base}\nSELECT id, number FROM all_timeline WHERE line <> 7"
    sql["review_state_norm"] = f"{raw}\nSELECT id, raw_state AS state FROM raw_reviews"
    sql["user_type_default"] = f"""{raw}
SELECT id, CASE WHEN actor_id % 20 = 0 THEN 'Bot' ELSE 'User' END AS type FROM all_reviews
UNION ALL SELECT number + 1000000, 'Organization' FROM raw_prs"""
    sql["commit_committer"] = f"""{raw}
SELECT sha, raw_login AS author, CASE WHEN id % 3 <> 0 THEN actor ELSE raw_login END AS committer FROM seen_commits"""
    sql["commit_required_fields"] = f"""{raw}
SELECT sha, number, message, ts_h AS date_h, line - 1 AS idx FROM usable_commits"""
    sql["pr_defaults"] = f"""{base}
SELECT number, merged,
       CASE WHEN number % 3 <> 0 THEN number % 9 ELSE 0 END AS commits,
       CASE WHEN number % 4 <> 0 THEN number % 101 ELSE 0 END AS additions,
       CASE WHEN number % 5 <> 0 THEN number % 53 ELSE 0 END AS deletions,
       CASE WHEN number % 6 <> 0 THEN number % 7 ELSE 0 END AS changed_files,
       CASE WHEN number % 7 <> 0 THEN number % 11 ELSE 0 END AS comments,
       CASE WHEN number % 8 <> 0 THEN number % 13 ELSE 0 END AS review_comments
FROM prs"""
    sql["pr_branches"] = f"""{base}
SELECT number, 'base' AS base_label, 'base-' || number AS base_ref, 'sha-base-' || number AS base_sha,
       repo_id + 200 AS base_user_id, repo_id AS base_repo_id,
       'head' AS head_label, 'head-' || number AS head_ref, 'sha-head-' || number AS head_sha,
       author_id AS head_user_id, repo_id AS head_repo_id
FROM prs"""
    sql["comments_union"] = f"""{base}
SELECT id, number, type, review_id, CAST(NULL AS BIGINT) AS in_reply_to_id, path,
       CASE WHEN type = 'review' THEN line END AS position,
       CASE WHEN type = 'review' THEN 'inline' ELSE 'thread' END AS body, ts_h AS created_h
FROM comments"""
    sql["split_repo_list"] = f"""{raw}
SELECT number + 1000000 AS id, title, unnest(['org/repo' || repo_id, 'head-' || number]) AS item FROM raw_prs"""

    # --- windows and links ---
    sql["dump_window"] = f"""{base}
SELECT 'pull_requests' AS "table", number AS row_id, created_h AS at_h FROM prs
UNION ALL SELECT 'reviews', id, ts_h FROM all_reviews, bounds WHERE ts_h BETWEEN ws AND we
UNION ALL SELECT 'commits', id, ts_h FROM all_commits, bounds WHERE ts_h BETWEEN ws AND we
UNION ALL SELECT 'comments', id, ts_h FROM all_comments, bounds WHERE ts_h BETWEEN ws AND we
UNION ALL SELECT 'timeline', id, ts_h FROM all_timeline, bounds WHERE ts_h BETWEEN ws AND we"""
    sql["children_in_window"] = f"""{raw}
SELECT 'reviews' AS "table", CAST(id AS VARCHAR) AS item, number FROM seen_reviews
UNION ALL SELECT 'commits', sha, number FROM usable_commits
UNION ALL SELECT 'comments', CAST(id AS VARCHAR), number FROM seen_comments
UNION ALL SELECT 'timeline', CAST(id AS VARCHAR), number FROM seen_timeline
UNION ALL SELECT 'files', 'blob' || number || filename, number FROM files"""
    sql["dedup_prs"] = f"""{raw}
SELECT number, title, ord AS line_ord, number AS first_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY ord DESC) AS rn FROM raw_prs) WHERE rn = 1"""
    sql["users_first_seen"] = f"{raw}\nSELECT id, login, type FROM people"
    sql["repositories_first_seen"] = f"""{base}
SELECT DISTINCT repo_id AS id, 'repo' || repo_id AS name, 'org/repo' || repo_id AS full_name, repo_id + 900 AS owner_id
FROM prs"""
    sql["acted_prs"] = f"""{base}
SELECT author AS user_login, number FROM prs
UNION SELECT actor, number FROM reviews UNION SELECT login, number FROM commits
UNION SELECT actor, number FROM comments UNION SELECT actor, number FROM timeline"""
    sql["subject_prs"] = f"""{raw}
SELECT number, title, u.login AS user_login, created_h FROM raw_kept JOIN people u ON u.id = author_id
WHERE number IN (SELECT number FROM kept)"""
    acted = """, acted AS (
  SELECT author AS login, number FROM prs
  UNION SELECT actor, number FROM reviews UNION SELECT login, number FROM commits
  UNION SELECT actor, number FROM comments UNION SELECT actor, number FROM timeline
), own AS (SELECT login AS subject_login, number FROM acted WHERE login IN (SELECT user_login FROM subjects))"""
    sql["subject_children"] = f"{base}{acted}\n" + "\nUNION ALL ".join(
        f"""SELECT '{t}' AS "table", subject_login, count(*) AS n, CAST(sum(id) AS BIGINT) AS sum_of_ids
FROM {t} JOIN own USING (number) GROUP BY subject_login"""
        for t in ("reviews", "commits", "comments", "timeline")
    )
    sql["dump_summary"] = f"""{raw}, kept_mentions AS (
  SELECT user_id FROM child_mentions
  UNION SELECT repo_id + 900 FROM raw_kept WHERE number IN (SELECT number FROM kept)
  UNION SELECT repo_id + 200 FROM raw_kept WHERE number IN (SELECT number FROM kept)
  UNION SELECT author_id FROM raw_kept WHERE number IN (SELECT number FROM kept)
  UNION SELECT (author_id + 1) % 97 FROM raw_kept WHERE merged AND number IN (SELECT number FROM kept)
)
SELECT 'users' AS "table", count(*) AS rows FROM kept_mentions
UNION ALL SELECT 'repositories', count(DISTINCT repo_id) FROM prs WHERE number IN (SELECT number FROM kept)
UNION ALL SELECT 'pull_requests', count(*) FROM prs WHERE number IN (SELECT number FROM kept)
UNION ALL SELECT 'commits', count(*) FROM usable_commits WHERE number IN (SELECT number FROM kept)
UNION ALL SELECT 'reviews', count(*) FROM seen_reviews WHERE number IN (SELECT number FROM kept)
UNION ALL SELECT 'comments', count(*) FROM seen_comments WHERE number IN (SELECT number FROM kept)"""

    sql["multi_dump_load"] = f"""
SELECT dump, summary.* FROM ({sql["dump_summary"]}) summary, (VALUES ('a'), ('b')) dumps(dump)"""

    sql["reload_changed_prs"] = f"""{raw}
SELECT 'pull_requests' AS "table", title || ' ' || u.login AS item, number FROM raw_kept JOIN people u ON u.id = author_id
UNION ALL SELECT 'reviews', r.id || ' ' || u.login, number FROM seen_reviews r JOIN people u ON u.id = actor_id
UNION ALL SELECT 'commits', sha || ' ' || u.login, number FROM usable_commits c JOIN people u ON u.id = user_id
UNION ALL SELECT 'comments', r.id || ' ' || u.login, number FROM seen_comments r JOIN people u ON u.id = actor_id
UNION ALL SELECT 'timeline', t.id || ' ' || u.login, number FROM seen_timeline t JOIN people u ON u.id = actor_id
UNION ALL SELECT 'files', 'blob' || number || filename, number FROM files
UNION ALL SELECT 'users', login || ' ' || type, id FROM people
UNION ALL SELECT DISTINCT 'repositories', 'org/repo' || repo_id, repo_id + 900 FROM prs"""
    sql["landed_period_reviews"] = f"""{raw}
SELECT u.login AS user_login, r.id, number FROM seen_reviews r JOIN people u ON u.id = actor_id
WHERE ts_h BETWEEN epoch(TIMESTAMP '1997-03-01') // 3600 AND epoch(TIMESTAMP '1997-08-31 23:00:00') // 3600"""
    header = sql["dump_summary"]
    sql["report_header_counts"] = f"""
SELECT 'user_7' AS user_login, CAST(epoch(TIMESTAMP '1996-01-01') // 3600 AS BIGINT) AS start_h,
       CAST(epoch(TIMESTAMP '2000-12-31') // 3600 AS BIGINT) AS end_h, summary.* FROM ({header}) summary"""
    sql["dump_to_report"] = f"""{raw}, own AS (
  SELECT p.*, u.login AS name FROM raw_kept p JOIN people u ON u.id = author_id WHERE u.login = 'user_7'
), counted AS (
  SELECT count(*) FILTER (created_h BETWEEN ws AND we) AS opened,
         count(*) FILTER (merged AND merged_h BETWEEN ws AND we) AS merged
  FROM own, bounds WHERE number IN (SELECT number FROM kept)
)
SELECT 'user_7' AS user_login, 'pr_throughput' AS metric_slug, opened, merged FROM counted
UNION ALL SELECT 'user_7', 'cycle_time', NULL, merged FROM counted
UNION ALL SELECT 'user_7', 'pr_merge_effectiveness', NULL, nullif(merged, 0) FROM counted"""

    # --- a user's rows ---
    sql["user_prs"] = f"""{base}
SELECT user_login, number FROM prs JOIN subjects ON author = user_login
WHERE created_h BETWEEN coalesce(ps, created_h) AND coalesce(pe, created_h)"""
    sql["user_merged_prs"] = f"""{base}
SELECT user_login, number FROM all_prs JOIN subjects ON author = user_login
WHERE merged AND merged_h BETWEEN coalesce(ps, merged_h) AND coalesce(pe, merged_h)"""
    sql["user_reviews"] = f"""{base}
SELECT user_login, id, number FROM reviews JOIN subjects ON actor = user_login
WHERE ts_h BETWEEN coalesce(ps, ts_h) AND coalesce(pe, ts_h)"""
    sql["user_commits"] = f"""{base}
SELECT user_login, sha, number FROM commits JOIN subjects ON login = user_login
WHERE ts_h BETWEEN coalesce(ps, ts_h) AND coalesce(pe, ts_h)"""
    naive = "epoch(TIMESTAMP '{}') // 3600 - ahead"
    within = f"BETWEEN {naive.format('1997-01-01')} AND {naive.format('1998-07-01')}"
    sql["user_prs_naive_bound"] = f"""{raw}
SELECT u.login AS user_login, number FROM raw_kept JOIN people u ON u.id = author_id, (SELECT 0 AS ahead)
WHERE created_h {within}"""
    sql["user_reviews_naive_bound"] = f"""{raw}, named AS (
  SELECT u.login AS user_login, r.id, ts_h, CASE WHEN r.id % 2 = 0 THEN 0 ELSE 2 END AS own
  FROM seen_reviews r JOIN people u ON u.id = actor_id
), clocks AS (SELECT user_login, arg_min(own, (ts_h, id)) AS ahead FROM named GROUP BY user_login)
SELECT user_login, id, CAST({naive.format('1997-01-01')} AS BIGINT) AS start_h
FROM named JOIN clocks USING (user_login) WHERE ts_h {within}"""
    sql["subject_defaults"] = f"""{base}, filled AS (
  SELECT user_login, CASE WHEN u % 2 = 0 THEN ws ELSE we - 365 * 24 END AS start_h, we AS end_h
  FROM (SELECT user_login, CAST(substr(user_login, 6) AS BIGINT) AS u FROM subjects), bounds
)
SELECT user_login, start_h, end_h, count(*) AS opened
FROM filled JOIN prs ON author = user_login AND created_h BETWEEN start_h AND end_h
GROUP BY user_login, start_h, end_h"""

    # --- lookups ---
    sql["pr_children"] = f"""{base}
SELECT number, (SELECT count(*) FROM reviews x WHERE x.number = p.number) AS reviews,
       (SELECT count(*) FROM commits x WHERE x.number = p.number AND x.number <> 0) AS commits,
       (SELECT count(*) FROM comments x WHERE x.number = p.number AND x.number <> 0) AS comments,
       (SELECT count(*) FROM files x WHERE x.number = p.number) AS files,
       (SELECT count(*) FROM timeline x WHERE x.number = p.number) AS timeline
FROM prs p"""
    sql["review_comments_by_review"] = f"""{base}
SELECT r.id, c.id AS comment_id, c.path FROM reviews r
LEFT JOIN comments c ON c.review_id = r.id AND c.review_id <> 0"""
    sql["review_with_pr"] = f"""{base}
SELECT r.id, r.number, p.author AS pr_author, p.merged, p.merged_h FROM reviews r LEFT JOIN prs p USING (number)"""
    sql["is_change_request"] = f"{followed}\nSELECT id, is_change_request FROM marks"
    sql["event_after_review"] = f"""{base}
SELECT id, EXISTS (SELECT 1 FROM timeline t WHERE t.number = r.number AND t.ts_h > r.ts_h) AS any_event_after,
       EXISTS (SELECT 1 FROM timeline t WHERE t.number = r.number AND t.ts_h > r.ts_h AND t.event = 'labeled')
         AS label_after
FROM reviews r"""
    sql["merged_after_review"] = f"{followed}\nSELECT id, merged_after FROM facts"
    sql["next_author_commit"] = f"""{followed}
SELECT id, number, round(CAST(next_commit - ts_h AS DOUBLE), 6) AS hours FROM followed"""
    sql["next_review"] = f"{followed}\nSELECT id, number, next_review * 3600000000 AS next_micros FROM followed"
    sql["effective_change_request"] = f"""{followed}
SELECT id, actor AS user_login, is_change_request, effective FROM facts"""
    sql["review_path_overlap"] = f"{followed}\nSELECT id, has_paths, NOT has_paths OR on_path AS passes FROM marks"
    sql["first_external_review"] = f"""{base}
SELECT r.number, min(r.ts_h) AS first_h FROM reviews r JOIN prs p USING (number) WHERE r.actor <> p.author
GROUP BY r.number"""

    # --- interactions and order ---
    sql["pr_interactions"] = f"{inter}\nSELECT number, actor, kind, at_h FROM interactions"
    sql["interaction_breakdown"] = f"""{inter}
SELECT number, count(*) AS back_and_forth, {
        ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('review', 'comment_issue', 'comment_review', 'timeline'))
    } FROM interactions WHERE merged GROUP BY number"""
    sql["pr_activity_seq"] = f"""{base}
SELECT number, kind, id AS row_id, row_number() OVER (PARTITION BY number ORDER BY ts_h, kind, id) AS seq FROM (
  SELECT number, 'review' AS kind, id, ts_h FROM reviews UNION ALL SELECT number, 'commit', id, ts_h FROM commits
  UNION ALL SELECT number, 'comment', id, ts_h FROM comments
  UNION ALL SELECT number, 'timeline', id, ts_h FROM timeline)"""
    sql["ordered_pr_numbers"] = f"""{base}
SELECT user_login, number, row_number() OVER (PARTITION BY author ORDER BY created_h, number) AS position
FROM prs JOIN subjects ON author = user_login
WHERE created_h BETWEEN coalesce(ps, created_h) AND coalesce(pe, created_h)"""
    sql["ordered_pr_numbers_open_period"] = f"""{base}
SELECT author AS user_login, number, row_number() OVER (PARTITION BY author ORDER BY created_h, number) AS position
FROM prs"""
    sql["merge_time_hours"] = f"""{base}
SELECT number, CAST(merged_h - created_h AS DOUBLE) AS merge_hours, CAST(closed_h - created_h AS DOUBLE) AS open_hours
FROM all_prs"""
    quantiles = ", ".join(
        f"round(quantile_cont(CAST(merged_h - created_h AS DOUBLE), {p}), 6) AS {name}"
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99), ("p100", 1.0))
    )
    sql["percentile_hours"] = f"""{base}
SELECT repo_id, count(*) AS n, {quantiles} FROM all_prs WHERE merged GROUP BY repo_id"""
    sql["review_iterations_per_pr"] = f"{all_metrics}\nSELECT user_login, number, iterations FROM iterations"

    # --- metrics ---
    rounded = {
        "pr_throughput": "opened_count, merged_count, round(merge_ratio, 6) AS merge_ratio",
        "cycle_time": "merged_count, round(median_hours, 6) AS median_hours, round(p75_hours, 6) AS p75_hours",
        "pr_merge_effectiveness": "merged_pr_count, round(average_merge_time_hours, 6) AS average_merge_time_hours, "
        "round(average_back_and_forth, 6) AS average_back_and_forth",
        "review_leverage": "total_reviews, change_requests, effective_changes, "
        "round(effectiveness_percentage, 6) AS effectiveness_percentage, updated_after_review, merged_after_review",
        "review_iterations": "merged_prs, round(average_iterations, 6) AS average_iterations",
        "time_to_first_review": "reviewed_prs, round(median_hours, 6) AS median_hours, round(p75_hours, 6) AS p75_hours",
        "slow_review_response": "samples, round(median_hours, 6) AS median_hours, round(p75_hours, 6) AS p75_hours",
    }
    for slug, columns in rounded.items():
        sql[slug] = f"{all_metrics}\nSELECT user_login, {columns} FROM {slug}"
    for slug in ("cycle_time", "pr_throughput"):
        sql[f"{slug}_from_summaries"] = sql[slug]
    sql["metric_ratings"] = _report({"metric_slug": "{slug}", "rating": "{rating}"})
    sql["metric_summaries"] = _report({"metric_slug": "{slug}", "summary": "{summary}"})
    sql["metric_results"] = _report(
        {
            "metric_slug": "{slug}",
            "metric_name": "{name}",
            "rating": "{rating}",
            "value": "round(CAST({value} AS DOUBLE), 6)",
        }
    )

    def items(
        slug: str, name: str, source: str, number: str = "number", hours: str = "0.0", effective: str = "false",
        iterations: str = "NULL::BIGINT",
    ) -> str:
        return f"""SELECT user_login, '{slug}' AS metric_slug, '{name}' AS list, count(*) AS n,
       CAST(sum({number}) AS BIGINT) AS sum_of_numbers,
       round(coalesce(sum(CAST({hours} AS DOUBLE)), 0.0), 6) AS sum_of_hours,
       count(*) FILTER ({effective}) AS effective, CAST(sum({iterations}) AS BIGINT) AS iterations,
       count(*) AS last_position
FROM {source} WHERE user_login IN (SELECT user_login FROM subjects) GROUP BY user_login"""

    leverage = "(SELECT * FROM own_reviews WHERE is_change_request)"
    sql["metric_items"] = f"{all_metrics}\n" + "\nUNION ALL ".join(
        [
            items("pr_throughput", "opened_pr_numbers", "opened"),
            items("pr_throughput", "merged_pr_numbers", "merged_in"),
            items("cycle_time", "per_pr_hours", "merged_in", hours="hours"),
            items("pr_merge_effectiveness", "pr_details", "back_and_forth", hours="hours"),
            items("review_iterations", "per_pr", "iterations", iterations="iterations"),
            items("time_to_first_review", "per_pr", "firsts", hours="hours"),
            items("slow_review_response", "per_review", "responses", hours="hours"),
            items("review_leverage", "change_request_details", leverage, effective="effective"),
        ]
    )
    # Lookups read whole tables, so their twins drop the window.
    for name in _WITHOUT_WINDOW:
        unclipped = sql[name].replace(", bounds WHERE ts_h BETWEEN ws AND we AND", " WHERE")
        sql[name] = unclipped.replace("FROM all_prs p, bounds WHERE created_h BETWEEN ws AND we", "FROM all_prs p")
    return sql


ORACLE: dict[str, str] = _build()
