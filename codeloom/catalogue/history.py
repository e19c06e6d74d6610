"""Queries over version-control history."""

import datetime

from codeloom.catalogue import register
from codeloom.operators import git

SINCE = datetime.date(1998, 8, 28)
_ROLL = """SELECT file_path, min(class_id) AS class_id, count(DISTINCT commit_id) AS commit_count, max(committed_at) AS last_modified,
    (SELECT max(x.author) FROM r x WHERE x.file_path = r.file_path AND x.committed_at = (SELECT max(y.committed_at) FROM r y WHERE y.file_path = r.file_path)) AS last_author,
    min(committed_at) AS first_commit, count(DISTINCT author) AS distinct_authors FROM r GROUP BY file_path"""
_ROWS = "r AS (SELECT file_path, class_id, commit_id, committed_at, author FROM commit_files JOIN commits ON commit_id = id {where})"
_HOT = "SELECT * FROM ({roll}) WHERE class_id NOT IN (SELECT id FROM classes WHERE lifecycle <> 'current') ORDER BY commit_count DESC, file_path LIMIT 10"
_BUSY = "t AS (SELECT file_path FROM commit_files GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"

register("hotspots_since", lambda s: git.hotspots(s, since=SINCE), f"{_ROWS.format(where=f'''WHERE committed_at >= TIMESTAMP '{SINCE}' ''')} {_HOT.format(roll=_ROLL)}")
register("hotspots_lifetime", git.hotspots, f"{_ROWS.format(where='')} {_HOT.format(roll=_ROLL)}")
register("hotspots_with_historical", lambda s: git.hotspots(s, include_historical=True, limit=25), f"{_ROWS.format(where='')} SELECT * FROM ({_ROLL}) ORDER BY commit_count DESC, file_path LIMIT 25")
register(
    "git_file_rollup",
    git.file_rollup,
    f"""{_ROWS.format(where='')}, m AS (SELECT file_path, max(committed_at) AS newest FROM r GROUP BY 1),
    a AS (SELECT r.file_path, max(author) AS last_author FROM r JOIN m ON r.file_path = m.file_path AND committed_at = newest GROUP BY 1)
    SELECT r.file_path, min(class_id) AS class_id, count(DISTINCT commit_id) AS commit_count, max(committed_at) AS last_modified, any_value(a.last_author) AS last_author,
    min(committed_at) AS first_commit, count(DISTINCT author) AS distinct_authors FROM r JOIN a ON a.file_path = r.file_path GROUP BY r.file_path""",
)
register(
    "co_changed_files",
    lambda s: git.co_changed(s, limit=100),
    f"""{_BUSY}, own AS (SELECT commit_id FROM commit_files WHERE file_path IN (SELECT file_path FROM t))
    SELECT file_path, min(class_id) AS class_id, count(*) AS co_changes, floor(count(*) * 1.0 / (SELECT count(DISTINCT commit_id) FROM own) * 100 + 0.5) / 100 AS ratio
    FROM own JOIN commit_files f ON f.commit_id = own.commit_id WHERE file_path NOT IN (SELECT file_path FROM t) GROUP BY file_path ORDER BY co_changes DESC, file_path LIMIT 100""",
)
register(
    "file_history",
    lambda s: git.file_history(s, limit=20),
    f"""{_BUSY} SELECT DISTINCT hash, author, author_email, committed_at, message, change_type FROM commit_files JOIN commits ON commit_id = id
    WHERE file_path IN (SELECT file_path FROM t) ORDER BY committed_at DESC, hash, change_type LIMIT 20""",
)
register(
    "file_history_identities",
    lambda s: git.author_identities(git.file_history(s, limit=20)),
    f"""{_BUSY}, h AS (SELECT DISTINCT hash, author, author_email, committed_at, change_type FROM commit_files JOIN commits ON commit_id = id
    WHERE file_path IN (SELECT file_path FROM t) ORDER BY committed_at DESC, hash, change_type LIMIT 20)
    SELECT author, count(DISTINCT hash) AS commits, count(DISTINCT author_email) AS addresses FROM h GROUP BY author""",
)
register(
    "recent_changes",
    git.recent_changes,
    """n AS (SELECT * FROM commits ORDER BY committed_at DESC, id DESC LIMIT 10)
    SELECT hash, author, committed_at, file_path, change_type FROM n JOIN commit_files ON id = commit_id ORDER BY committed_at DESC, file_path, hash, change_type LIMIT 200""",
)
register(
    "resolve_entities",
    lambda s: git.resolve_entities(s, ["C52.java", "src/main/java/C7.java", "C5.java", "nothing.java"]),
    """t AS (SELECT unnest(['C52.java', 'src/main/java/C7.java', 'C5.java', 'nothing.java']) AS target), k AS (SELECT source_file AS path, lifecycle FROM classes UNION ALL SELECT path, lifecycle FROM files)
    SELECT target, count(path) AS candidates, CASE WHEN count(path) = 0 THEN 'not_found' WHEN bool_or(lifecycle = 'current') THEN 'current' ELSE 'historical' END AS resolution
    FROM t LEFT JOIN k ON path = target OR path LIKE '%/' || target GROUP BY target""",
)
