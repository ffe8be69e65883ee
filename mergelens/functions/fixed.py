"""Names, formats and limits that results must reproduce."""

from __future__ import annotations

# Provider names with a reader.
PROVIDERS = ("github",)

# Files of a dump.
MANIFEST_FILE = "dump_manifest.json"
CANONICAL_DIR = "canonical"
TABLE_FILES = {
    "pull_requests": "pull_requests.jsonl",
    "reviews": "reviews.jsonl",
    "review_comments": "review_comments.jsonl",
    "issue_comments": "issue_comments.jsonl",
    "commits": "commits.jsonl",
    "files": "files.jsonl",
    "timeline": "timeline.jsonl",
}

# Domains.
USER_TYPES = ("User", "Organization", "Bot")
PR_STATES = ("open", "closed")
REVIEW_STATES = ("approved", "changes_requested", "commented")
CHANGES_REQUESTED = "changes_requested"
COMMENTED = "commented"
INTERACTION_KINDS = ("review", "comment_issue", "comment_review", "timeline")
INTERACTION_EVENTS = ("reviewed", "commented")
MERGED_EVENT = "merged"
BOT = "Bot"

# Time limits.
RESPONSE_HOURS = 72
DEFAULT_PERIOD_DAYS = 365

# Metric names by slug, in report order.
METRIC_NAMES = {
    "pr_merge_effectiveness": "PR Merge Effectiveness",
    "review_leverage": "Review Leverage",
    "pr_throughput": "PR Throughput",
    "cycle_time": "Cycle Time",
    "review_iterations": "Review Iterations",
    "time_to_first_review": "Time to First Review",
    "slow_review_response": "Slow Review Response",
}

# Rating limits. (slug, rated value, direction, excellent, good, neutral).
# "up" rates value >= limit, "down" rates value <= limit; beyond the last is "bad".
RATING_LIMITS = (
    ("pr_throughput", "merge_ratio", "up", 0.9, 0.7, 0.5),
    ("cycle_time", "median_hours", "down", 1.0, 3.0, 7.0),
    ("pr_merge_effectiveness", "average_back_and_forth", "down", 1.0, 2.0, 4.0),
    ("review_leverage", "effectiveness_percentage", "up", 80.0, 60.0, 30.0),
    ("review_iterations", "average_iterations", "down", 1.0, 2.0, 4.0),
    ("time_to_first_review", "median_hours", "down", 1.0, 6.0, 24.0),
    ("slow_review_response", "median_hours", "down", 2.0, 12.0, 48.0),
)

# Summaries of subjects without data.
NO_MERGED_PRS = "No PRs merged in the period."
NO_CHANGE_REQUESTS = "No change requests made."
