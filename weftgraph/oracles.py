"""DuckDB SQL for the queries of the catalogue, on the same star projection."""

from __future__ import annotations

GRAPH = """
person AS (SELECT c_custkey AS id, c_mktsegment AS first_name, c_name AS last_name, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
  c_custkey * 37 % 12000 * 86400000 AS birthday, c_custkey * 1000 AS creation_date, '10.0.0.' || (c_custkey % 256) AS location_ip,
  CASE WHEN c_custkey % 3 = 0 THEN 'Firefox' ELSE 'Chrome' END AS browser_used, CAST(c_nationkey + 1000 AS BIGINT) AS place,
  CASE WHEN c_custkey % 2 = 0 THEN 'en;de' ELSE 'en' END AS language, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || '@a.org;' || c_name || '@b.org' END AS email FROM customer),
place AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'country' AS type, CAST(n_regionkey + 100 AS BIGINT) AS is_part_of FROM nation
  UNION ALL SELECT r_regionkey + 100, r_name, 'continent', NULL FROM region UNION ALL SELECT n_nationkey + 1000, n_name || '_CITY', 'city', n_nationkey FROM nation),
organisation AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS place FROM supplier),
tag AS (SELECT p_partkey AS id, p_name || '#' || p_partkey AS name, CAST(substr(p_brand, 7) AS BIGINT) AS has_type FROM part),
tag_class AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, p_brand AS name, CAST(substr(p_brand, 7) AS BIGINT) % 5 + 100 AS is_subclass_of FROM part
  UNION ALL SELECT 100 + range, 'Group#' || range, 0 FROM range(5) UNION ALL SELECT 0, 'Thing', NULL),
forum AS (SELECT s_suppkey AS id, s_name AS title, s_suppkey AS moderator FROM supplier),
post AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS creation_date, CASE WHEN o_orderstatus = 'P' THEN 'img' || o_orderkey ELSE o_orderpriority END AS content,
  o_custkey AS creator, f.forum, CAST(s_nationkey AS BIGINT) AS place FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS forum FROM lineitem GROUP BY 1) f ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = f.forum),
comment AS (SELECT 1000000000 + event_id AS id, (epoch_ns(ts) // 1000000) AS creation_date, event_type AS content, user_id AS creator, event_id % 25 AS place,
  CASE WHEN event_id % 3 = 0 THEN event_id * 7 % (SELECT count(*) FROM orders) END AS reply_of_post, CASE WHEN event_id % 3 <> 0 THEN 999999999 + event_id END AS reply_of_comment FROM events),
message AS (SELECT 'post' AS kind, id, creation_date, content, creator, place, forum, CAST(NULL AS BIGINT) AS reply_of_post, CAST(NULL AS BIGINT) AS reply_of_comment FROM post
  UNION ALL SELECT 'comment', id, creation_date, content, creator, place, NULL, reply_of_post, reply_of_comment FROM comment),
pairs AS (SELECT lag(o_custkey) OVER w AS a, o_custkey AS b, epoch_ms(o_orderdate) AS ms FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)),
knows AS (SELECT src, dst, min(ms) AS creation_date FROM (SELECT a AS src, b AS dst, ms FROM pairs UNION ALL SELECT b, a, ms FROM pairs) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL),
likes_post AS (SELECT user_id AS src, event_id % (SELECT count(*) FROM orders) AS dst, min((epoch_ns(ts) // 1000000)) AS creation_date FROM events WHERE event_type = 'click' GROUP BY ALL),
likes_comment AS (SELECT user_id AS src, 1000000000 + event_id * 13 % (SELECT count(*) FROM events) AS dst, min((epoch_ns(ts) // 1000000)) AS creation_date FROM events WHERE event_type = 'view' GROUP BY ALL),
lo AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
has_member AS (SELECT l_suppkey AS src, o_custkey AS dst, min(epoch_ms(o_orderdate)) AS join_date FROM lo GROUP BY ALL),
study_at AS (SELECT o_custkey AS src, l_suppkey AS dst, CAST(min(year(o_orderdate)) AS INTEGER) AS class_year FROM lo WHERE l_linenumber = 3 GROUP BY ALL),
work_at AS (SELECT o_custkey AS src, l_suppkey AS dst, CAST(min(year(o_orderdate)) AS INTEGER) AS work_from FROM lo WHERE l_linenumber = 2 GROUP BY ALL),
has_interest AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM lo WHERE l_linenumber = 1),
post_has_tag AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem),
me AS (SELECT src AS p FROM knows GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
friends AS (SELECT DISTINCT dst AS v FROM knows, me WHERE src = p),
hop2 AS (SELECT DISTINCT v FROM (SELECT v FROM friends UNION ALL SELECT k.dst FROM friends f JOIN knows k ON k.src = f.v), me WHERE v <> p),
roots AS (SELECT id, 0 AS n, reply_of_post AS root_post, reply_of_comment AS next FROM comment UNION ALL
  SELECT r.id, n + 1, c.reply_of_post, c.reply_of_comment FROM roots r JOIN comment c ON c.id = r.next WHERE r.root_post IS NULL),
root AS (SELECT id, root_post FROM roots WHERE root_post IS NOT NULL UNION ALL SELECT id, id FROM post),
someone AS (SELECT id AS m FROM comment WHERE reply_of_comment IS NOT NULL ORDER BY id LIMIT 1),
answered AS (SELECT reply_of_comment AS m FROM comment WHERE reply_of_comment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
far AS (SELECT id AS q FROM person, me WHERE id <> p AND id IN (SELECT src FROM knows) ORDER BY abs(id - p) DESC, id LIMIT 1)
"""

X, Y, START, DAYS, MIN_DATE, MAX_DATE, NAME, COUNTRY, YEAR, MONTH, CLASS = "NATION_3", "NATION_7", 852076800000, 1200, 883612800000, 1705276800000, "BUILDING", "NATION_5", 1999, 5, "Group#2"
#: For the store's queries: edges that make a part of its own, edges of a segment, single writes, sources looked up.
LARGE_PART, SEGMENT, WRITES, PROBED = 2000, 1500, 400, 8
END = START + DAYS * 86_400_000
_POST_OF = "post JOIN friends ON creator = v"


def _sql(body: str) -> str:
    return f"WITH RECURSIVE {GRAPH} {body}"


def _born(column: str) -> str:
    date = f"(DATE '1970-01-01' + CAST({column} // 86400000 AS INTEGER))"
    return f"((month({date}) = {MONTH} AND day({date}) >= 21) OR (month({date}) = {MONTH % 12 + 1} AND day({date}) < 22))"


def _messages(who: str, test: str) -> str:
    return f"""SELECT creator AS person_id, first_name AS person_first_name, last_name AS person_last_name, m.id AS message_id, content AS message_content, m.creation_date AS message_creation_date
      FROM (SELECT message.* FROM message JOIN {who} ON creator = v WHERE creation_date {test} {MAX_DATE} ORDER BY creation_date DESC, id LIMIT 20) m JOIN person ON person.id = creator"""


def _orgs(edge: str, year: str) -> str:
    return f"""coalesce((SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT o.name || ',' || e.{year} || ',' || pl.name AS x FROM {edge} e JOIN organisation o ON o.id = e.dst JOIN place pl ON pl.id = o.place WHERE e.src = n.id)), ',0,')"""


_PATH_WALK = """walk AS (SELECT p AS v, 0 AS d FROM me UNION SELECT k.dst, d + 1 FROM walk JOIN knows k ON k.src = walk.v WHERE d < 8),
  level AS (SELECT v, min(d) AS d FROM walk GROUP BY v), goal AS (SELECT q, d FROM level, far WHERE v = q)"""
_WEIGHTS = """replies AS (SELECT c.creator AS a, p.creator AS b, 1.0 AS w FROM comment c JOIN post p ON p.id = c.reply_of_post UNION ALL
  SELECT c.creator, o.creator, 0.5 FROM comment c JOIN comment o ON o.id = c.reply_of_comment),
  weights AS (SELECT least(a, b) AS p1, greatest(a, b) AS p2, CAST(sum(w) AS DOUBLE) AS weight FROM replies GROUP BY ALL)"""
_LOG = "log AS (SELECT user_id AS src, event_id % 97 AS dst, 1 AS edge_type, event_id AS ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS marker FROM events)"


def _visible(where: str = "true") -> str:
    return f"SELECT src, dst, edge_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY src, edge_type, dst ORDER BY ts DESC) AS n FROM log WHERE {where}) WHERE n = 1 AND marker = 0"


ORACLES = {
    "graph_person": _sql("SELECT * FROM person"),
    "graph_knows": _sql("SELECT * FROM knows"),
    "graph_message": _sql("SELECT kind, id, creation_date, content, creator, place, forum, reply_of_post, reply_of_comment FROM message"),
    "graph_relation_counts": _sql("""SELECT * FROM (SELECT 'KNOWS' AS relation, count(*) AS n FROM knows UNION ALL SELECT 'HAS_CREATOR', count(*) FROM message UNION ALL SELECT 'HAS_TYPE', count(*) FROM tag
      UNION ALL SELECT 'HAS_TAG', (SELECT count(*) FROM post_has_tag) + (SELECT count(*) FROM events) + (SELECT count(*) FROM supplier)
      UNION ALL SELECT 'IS_LOCATED_IN', (SELECT count(*) FROM person) + (SELECT count(*) FROM message) + (SELECT count(*) FROM organisation)
      UNION ALL SELECT 'IS_PART_OF', count(*) FROM place WHERE is_part_of IS NOT NULL UNION ALL SELECT 'LIKES_COMMENT', count(*) FROM likes_comment UNION ALL SELECT 'LIKES_POST', count(*) FROM likes_post
      UNION ALL SELECT 'REPLY_OF_COMMENT', count(*) FROM comment WHERE reply_of_comment IS NOT NULL UNION ALL SELECT 'REPLY_OF_POST', count(*) FROM comment WHERE reply_of_post IS NOT NULL
      UNION ALL SELECT 'CONTAINER_OF', count(*) FROM post UNION ALL SELECT 'HAS_MEMBER', count(*) FROM has_member UNION ALL SELECT 'HAS_MODERATOR', count(*) FROM forum UNION ALL SELECT 'HAS_INTEREST', count(*) FROM has_interest
      UNION ALL SELECT 'STUDY_AT', count(*) FROM study_at UNION ALL SELECT 'WORK_AT', count(*) FROM work_at UNION ALL SELECT 'IS_SUBCLASS_OF', count(*) FROM tag_class WHERE is_subclass_of IS NOT NULL)"""),
    "vid_roundtrip": _sql("SELECT id, (1::BIGINT << 56) | id AS vid, CAST(1 AS INTEGER) AS label, id AS external_id FROM person"),
    "expand_out_knows": _sql("SELECT v, dst FROM friends JOIN knows ON src = v"),
    "expand_in_creator": _sql("SELECT v, id, kind FROM friends JOIN message ON creator = v"),
    "expand_with_prop": _sql("SELECT src AS forum, dst AS person, join_date FROM has_member, me WHERE dst = p"),
    "org_entries": _sql(f"SELECT id AS person, {_orgs('work_at', 'work_from')} AS companies FROM person n"),
    "k_hop_2": _sql("SELECT v FROM hop2"),
    "fof": _sql("SELECT v FROM hop2 WHERE v NOT IN (SELECT v FROM friends)"),
    "bfs_distance": _sql(""", walk AS (SELECT p AS v, 0 AS d FROM me UNION SELECT k.dst, d + 1 FROM walk JOIN knows k ON k.src = walk.v WHERE d < 3)
      SELECT v, CAST(min(d) AS INTEGER) AS distance FROM walk, me WHERE v <> p GROUP BY v"""),
    "bfs_levels": _sql(f", {_PATH_WALK} SELECT CAST(d AS INTEGER) AS depth, count(*) AS n FROM level WHERE d <= 4 GROUP BY d"),
    "shortest_path_length": _sql(f", {_PATH_WALK} SELECT CAST(coalesce((SELECT d FROM goal), -1) AS INTEGER) AS shortest_path_length"),
    "all_shortest_paths": _sql(f""", {_PATH_WALK}, path AS (SELECT [q] AS path, q AS head, d FROM goal UNION ALL
      SELECT list_prepend(k.src, path), k.src, path.d - 1 FROM path JOIN knows k ON k.dst = path.head JOIN level l ON l.v = k.src AND l.d = path.d - 1)
      SELECT array_to_string(path, ',') AS path FROM path WHERE d = 0"""),
    "pair_weight": _sql(f", {_WEIGHTS} SELECT * FROM weights"),
    "root_post": _sql("SELECT id, root_post FROM roots WHERE root_post IS NOT NULL"),
    "tagclass_descendants": _sql(f", below AS (SELECT id FROM tag_class WHERE name = 'Thing' UNION SELECT c.id FROM tag_class c JOIN below b ON c.is_subclass_of = b.id) SELECT id FROM below"),
    "argmax_like": _sql("""SELECT src AS liker, dst AS post, creation_date AS like_date FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY creation_date DESC, dst) AS n FROM likes_post) WHERE n = 1"""),
    "zero_preserving_forum_count": _sql("SELECT m.src AS forum, m.dst AS person, count(post.id) AS post_count FROM has_member m LEFT JOIN post ON post.forum = m.src AND post.creator = m.dst GROUP BY ALL"),
    "conditional_tag_count": _sql(f"""SELECT t.dst AS tag, bool_or(creation_date < {START}) AS existed_before, count(*) FILTER (WHERE creation_date >= {START} AND creation_date < {END}) AS in_window
      FROM post JOIN post_has_tag t ON t.src = post.id GROUP BY 1"""),
    "distinct_names_desc": _sql("SELECT i.src AS person, string_agg(DISTINCT first_word, ';' ORDER BY first_word DESC) AS names FROM (SELECT src, split_part(name, '#', 1) AS first_word FROM has_interest JOIN tag ON tag.id = dst) i GROUP BY 1"),
    "adjacency_build": f"WITH {_LOG}, d AS (SELECT src, edge_type, dst, max(ts) AS ts, count(*) AS records FROM log GROUP BY ALL) SELECT src, edge_type, string_agg(dst, ',' ORDER BY ts DESC, dst) AS neighbors, CAST(sum(records) AS BIGINT) AS records, CAST(sum(records) - count(*) AS BIGINT) AS duplicates FROM d GROUP BY ALL",
    "l0_partitions": f"""WITH {_LOG}, v AS (SELECT ((src % 2 + 1) << 56) | src AS src, src % 2 + 1 AS label, CASE WHEN ts % 10 < 7 THEN 1 WHEN ts % 10 < 9 THEN 2 ELSE 3 END AS edge_type FROM log),
      p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY label, edge_type) >= {LARGE_PART} THEN edge_type ELSE 0 END AS part FROM v)
      SELECT CAST(label AS INTEGER) AS label, CAST(part AS INTEGER) AS part, count(*) AS edges, count(DISTINCT src) AS sources, min(src) AS min_src, max(src) AS max_src FROM p GROUP BY 1, 2""",
    "segment_layout": f"WITH {_LOG} SELECT count(*) AS edges, count(DISTINCT src) AS sources, count(*) > {SEGMENT} AS several, CAST(0 AS BIGINT) AS cut_sources FROM log",
    "store_writes": f"""WITH {_LOG}, w AS (SELECT src, dst, edge_type, row_number() OVER (ORDER BY ts) AS ts, marker FROM log WHERE ts < {WRITES}), n AS (SELECT *, row_number() OVER (PARTITION BY src, edge_type, dst ORDER BY ts DESC) AS nth FROM w)
      SELECT src, dst, edge_type, ts FROM n WHERE nth = 1 AND marker = 0""",
    "compact_partition": f"""WITH {_LOG}, v AS (SELECT src, dst, ts, marker, CAST(src % 2 + 1 AS INTEGER) AS label, CASE WHEN ts % 10 < 7 THEN 1 WHEN ts % 10 < 9 THEN 2 ELSE 3 END AS edge_type FROM log),
      l AS (SELECT label, edge_type, CASE WHEN label = 1 AND edge_type = 2 THEN 1 ELSE 0 END AS level, CASE WHEN label = 1 AND edge_type = 2 THEN 1 ELSE count(DISTINCT ts % 2) END AS segments FROM v GROUP BY label, edge_type),
      s AS (SELECT label, edge_type, count(*) AS edges FROM (SELECT *, row_number() OVER (PARTITION BY src, edge_type, dst ORDER BY ts DESC) AS n FROM v) WHERE n = 1 AND marker = 0 GROUP BY ALL)
      SELECT label, edge_type, level, CAST(segments AS BIGINT) AS segments, edges FROM l JOIN s USING (label, edge_type)""",
    "compaction_score": f"""WITH {_LOG}, p AS (SELECT ts % 4 AS piece, min(src) AS low, max(src) AS high, count(*) AS n FROM log GROUP BY 1), q AS (SELECT range AS s FROM range({PROBED})),
      c AS (SELECT s, piece, EXISTS (SELECT 1 FROM log WHERE src = s AND ts % 4 = piece) AS held FROM q JOIN p ON s BETWEEN low AND high),
      r AS (SELECT q.s // 4 * 4 AS range_start, count(DISTINCT q.s) AS queries, count(piece) AS candidates, count(*) FILTER (WHERE piece IS NOT NULL AND NOT held) AS misses FROM q LEFT JOIN c USING (s) GROUP BY 1),
      b AS (SELECT range_start, sum(n) * 32 AS bytes, count(*) AS segments FROM r JOIN p ON low < range_start + 4 AND high >= range_start GROUP BY 1)
      SELECT range_start, round(queries * greatest(candidates / queries, 1.0) * (1 + CASE WHEN candidates > 0 THEN misses / candidates ELSE 0 END) / greatest(bytes / 1048576.0, 1.0), 6) AS score FROM r JOIN b USING (range_start) WHERE segments >= 2""",
    "adjacency_cache": f"WITH {_LOG}, v AS ({_visible()}) SELECT src, dst, edge_type, row_number() OVER (PARTITION BY src, edge_type ORDER BY ts, dst DESC) AS ts FROM v",
    "bucket_floor": "SELECT CAST(o_orderkey AS BIGINT) AS id, ((3::BIGINT << 56) | (o_orderkey * 1000003)) - ((3::BIGINT << 56) | (o_orderkey * 1000003)) % 1048576 AS bucket FROM orders",
    **dict.fromkeys(("update_batch", "update_replay"), """SELECT l_suppkey % 50 AS src, l_orderkey % 200 AS dst, arg_max(l_orderkey * 10 + l_linenumber, CASE WHEN l_linenumber = 2 THEN 0 ELSE 1000000000000 END + l_orderkey * 10 + l_linenumber) AS creation_date, count(*) AS n FROM lineitem GROUP BY 1, 2"""),
    "csv_roundtrip": _sql("SELECT *, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS frame, count(*) AS n FROM {t}" for t in ("place", "organisation", "tag", "tag_class", "person", "forum", "post", "comment", "knows", "likes_comment", "likes_post", "has_interest", "study_at", "work_at", "has_member", "post_has_tag")) + " UNION ALL SELECT 'forum_has_tag', count(*) FROM supplier UNION ALL SELECT 'comment_has_tag', count(*) FROM events)"),
    "dispatch_reads": _sql("SELECT p AS person, (SELECT count(*) FROM knows WHERE src = p) AS friends, CAST(2 AS BIGINT) AS checked, CAST(1 AS BIGINT) AS passed, CAST(1 AS BIGINT) AS updated, CAST(1 AS BIGINT) AS failed FROM me"),
    "iu_apply_batch": _sql(" UNION ALL ".join(f"SELECT '{frame}' AS frame, {'(SELECT count(*) FROM ' + {'forum_has_tag': 'supplier', 'comment_has_tag': 'events'}.get(frame, frame) + ')'} + {fresh} AS n, '{rows}' AS new_rows" for frame, fresh, rows in (
      ("person", 1, "5000000000|A|C|female|0|1|1000|en"), ("post", 1, "5000000000|1|x|5000000000|5000000000|1"), ("comment", 1, "5000000000|2|y|5000000000|1|5000000000|-"), ("forum", 1, "5000000000|F|5000000000"),
      ("knows", 2, "1|5000000000|6;5000000000|1|6"), ("likes_post", 1, "5000000000|5000000000|2"), ("likes_comment", 1, "5000000000|5000000000|4"), ("has_member", 1, "5000000000|5000000000|9"),
      ("has_interest", 2, "5000000000|1;5000000000|2"), ("forum_has_tag", 1, "5000000000|3"), ("post_has_tag", 1, "5000000000|1"), ("comment_has_tag", 1, "5000000000|4"), ("study_at", 1, "5000000000|1|2000"), ("work_at", 1, "5000000000|2|2001")))),
    "segment_stats": f"WITH {_LOG} SELECT src % 4 AS bucket, count(DISTINCT src) AS sources, 0 AS src_label, 1 AS single_type, min(src) AS min_src, max(src) AS max_src, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS edges FROM log GROUP BY 1",
    "visibility_merge_latest": f"WITH {_LOG} {_visible()}",
    "visibility_merge_snapshot": f"WITH {_LOG} {_visible('ts <= (SELECT max(ts) // 2 FROM log)')}",
    "typed_neighbors": f"WITH {_LOG} SELECT edge_type, dst FROM ({_visible()}) WHERE src = (SELECT src FROM log GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)",
    "compaction_preserves": f"WITH {_LOG} {_visible()}",
    "neighbors_overlay": _sql(f", {_LOG}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, edge_type, dst ORDER BY ts DESC) AS n FROM log) WHERE n = 1), base AS (SELECT src, 1 AS edge_type, dst FROM knows)"
      " SELECT src, edge_type, dst FROM base b WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.src = b.src AND n.edge_type = b.edge_type AND n.dst = b.dst) UNION ALL SELECT src, edge_type, dst FROM newest WHERE marker = 0"),
    "birthday_window": _sql(f"SELECT id, birthday FROM person WHERE {_born('birthday')}"),
    "minutes_latency": _sql("SELECT l.src, l.dst, CAST(sign(l.creation_date - c.creation_date) * (abs(l.creation_date - c.creation_date) // 60000) AS BIGINT) AS minutes FROM likes_comment l JOIN comment c ON c.id = l.dst"),
    "split_list": _sql("SELECT id, CASE WHEN email = '' THEN 0 ELSE len(string_split(email, ';')) END AS emails, email AS joined FROM person"),
    "latency_histogram": """WITH b AS (SELECT unnest([100, 250, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 250000, 500000, 1000000, 5000000, 30000000, 9223372036854775807]) AS bound),
      v AS (SELECT CAST(floor(value * 1000) AS BIGINT) AS us FROM events), c AS (SELECT (SELECT min(bound) FROM b WHERE us <= bound) AS upper_bound_us, count(*) AS n FROM v GROUP BY 1)
      SELECT CAST(upper_bound_us AS BIGINT) AS upper_bound_us, n, CAST(sum(n) OVER (ORDER BY upper_bound_us) AS BIGINT) AS seen FROM c""",
    "set_difference": _sql(f"SELECT 'missing' AS side, src, dst FROM (SELECT src, dst FROM knows WHERE creation_date >= {START} EXCEPT SELECT src, dst FROM knows WHERE creation_date < {END}) UNION ALL SELECT 'extra', src, dst FROM (SELECT src, dst FROM knows WHERE creation_date < {END} EXCEPT SELECT src, dst FROM knows WHERE creation_date >= {START})"),
    "place_incoming_messages": _sql(f"SELECT m.id, m.creator FROM message m JOIN place ON place.id = m.place WHERE name = '{X}' AND type = 'country' AND creation_date >= {START} AND creation_date < {END}"),
    "xy_residents": _sql(f"SELECT person.id AS v FROM person JOIN place c ON c.id = person.place WHERE c.is_part_of IN (SELECT id FROM place WHERE type = 'country' AND name IN ('{X}', '{Y}'))"),
    "ic1": _sql(f""", walk AS (SELECT p AS v, 0 AS d FROM me UNION SELECT k.dst, d + 1 FROM walk JOIN knows k ON k.src = walk.v WHERE d < 3), near AS (SELECT v, min(d) AS d FROM walk, me WHERE v <> p GROUP BY v),
      n AS (SELECT d, person.* FROM near JOIN person ON id = v WHERE first_name = '{NAME}' ORDER BY d, last_name, id LIMIT 20)
      SELECT n.id AS friend_id, last_name AS friend_last_name, CAST(d AS INTEGER) AS distance_from_person, birthday AS friend_birthday, creation_date AS friend_creation_date, gender AS friend_gender, browser_used AS friend_browser_used,
      location_ip AS friend_location_ip, email AS friend_emails, language AS friend_languages, c.name AS friend_city_name, {_orgs('study_at', 'class_year')} AS friend_universities, {_orgs('work_at', 'work_from')} AS friend_companies FROM n JOIN place c ON c.id = n.place"""),
    "ic2": _sql(_messages("friends", "<=")),
    "ic3": _sql(f""", xy AS (SELECT id, name FROM place WHERE type = 'country' AND name IN ('{X}', '{Y}')), near AS (SELECT v FROM hop2 WHERE v NOT IN (SELECT person.id FROM person JOIN place c ON c.id = person.place WHERE c.is_part_of IN (SELECT id FROM xy))),
      c AS (SELECT creator, count(*) FILTER (WHERE name = '{X}') AS x_count, count(*) FILTER (WHERE name = '{Y}') AS y_count FROM message m JOIN xy ON xy.id = m.place JOIN near ON v = creator WHERE creation_date >= {START} AND creation_date < {END} GROUP BY 1)
      SELECT creator AS person_id, first_name AS person_first_name, last_name AS person_last_name, x_count, y_count, x_count + y_count AS "count" FROM c JOIN person ON id = creator WHERE x_count > 0 AND y_count > 0 ORDER BY x_count + y_count DESC, creator LIMIT 20"""),
    "ic4": _sql(f"""SELECT name AS tag_name, post_count FROM (SELECT t.dst, bool_or(creation_date < {START}) AS old, count(*) FILTER (WHERE creation_date >= {START} AND creation_date < {END}) AS post_count FROM {_POST_OF} JOIN post_has_tag t ON t.src = post.id GROUP BY 1) x JOIN tag ON tag.id = x.dst
      WHERE NOT old AND post_count > 0 ORDER BY post_count DESC, name LIMIT 10"""),
    "ic5": _sql(f"""SELECT title AS forum_title, post_count FROM (SELECT m.src, count(post.id) AS post_count FROM has_member m JOIN hop2 ON v = m.dst LEFT JOIN post ON post.forum = m.src AND post.creator = m.dst WHERE join_date >= {MIN_DATE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) x JOIN forum ON id = src"""),
    "ic6": _sql("""SELECT name AS tag_name, count(*) AS post_count FROM post_has_tag t JOIN tag ON tag.id = t.dst WHERE t.src IN (SELECT post.id FROM post JOIN hop2 ON v = creator JOIN post_has_tag o ON o.src = post.id, hot WHERE o.dst = hot.tag) AND t.dst <> (SELECT tag FROM hot)
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""").replace("WITH RECURSIVE ", "WITH RECURSIVE hot AS (SELECT l_partkey AS tag FROM lineitem GROUP BY 1 ORDER BY count(DISTINCT l_orderkey) DESC, 1 LIMIT 1), "),
    "ic7": _sql(""", mine AS (SELECT message.* FROM message, liked WHERE creator = liked.p), l AS (SELECT m.*, k.src AS liker, k.creation_date AS like_date FROM mine m JOIN likes_post k ON kind = 'post' AND k.dst = m.id UNION ALL SELECT m.*, k.src, k.creation_date FROM mine m JOIN likes_comment k ON kind = 'comment' AND k.dst = m.id),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY liker ORDER BY like_date DESC, id) AS n FROM l) WHERE n = 1 ORDER BY like_date DESC, liker LIMIT 20)
      SELECT liker AS person_id, first_name AS person_first_name, last_name AS person_last_name, like_date AS like_creation_date, best.id AS message_id, content AS message_content,
      CAST(sign(like_date - best.creation_date) * (abs(like_date - best.creation_date) // 60000) AS BIGINT) AS minutes_latency, liker NOT IN (SELECT dst FROM knows, liked WHERE src = liked.p) AS is_new FROM best JOIN person ON person.id = liker""")
      .replace("WITH RECURSIVE ", "WITH RECURSIVE liked AS (SELECT user_id AS p FROM events WHERE event_id IN (SELECT event_id * 13 % (SELECT count(*) FROM events) FROM events WHERE event_type = 'view') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "),
    "ic8": _sql("""SELECT creator AS person_id, first_name AS person_first_name, last_name AS person_last_name, c.creation_date AS comment_creation_date, c.id AS comment_id, content AS comment_content FROM
      (SELECT comment.* FROM comment, me WHERE reply_of_post IN (SELECT id FROM post WHERE creator = p) OR reply_of_comment IN (SELECT id FROM comment WHERE creator = p) ORDER BY creation_date DESC, id LIMIT 20) c JOIN person ON person.id = creator"""),
    "ic9": _sql(_messages("hop2", "<")),
    "ic10": _sql(f""", c AS (SELECT v, id, first_name, last_name, gender, place FROM hop2 JOIN person ON id = v WHERE v NOT IN (SELECT v FROM friends) AND {_born('birthday')} AND EXISTS (SELECT 1 FROM has_interest, me WHERE src = p)),
      s AS (SELECT c.*, (SELECT coalesce(sum(CASE WHEN post.id IN (SELECT t.src FROM post_has_tag t WHERE t.dst IN (SELECT dst FROM has_interest, me WHERE src = p)) THEN 1 ELSE -1 END), 0) FROM post WHERE creator = v) AS score FROM c ORDER BY score DESC, id LIMIT 10)
      SELECT s.id AS person_id, first_name AS person_first_name, last_name AS person_last_name, CAST(score AS BIGINT) AS common_interest_score, gender AS person_gender, place.name AS person_city_name FROM s JOIN place ON place.id = s.place"""),
    "ic11": _sql(f"""SELECT w.src AS person_id, first_name AS person_first_name, last_name AS person_last_name, o.name AS organization_name, work_from AS organization_work_from_year FROM work_at w JOIN hop2 ON v = w.src JOIN organisation o ON o.id = w.dst JOIN place c ON c.id = o.place AND c.name = '{COUNTRY}'
      JOIN person ON person.id = w.src WHERE work_from < {YEAR} ORDER BY work_from, w.src, o.name DESC LIMIT 10"""),
    "ic12": _sql(f""", below AS (SELECT id FROM tag_class WHERE name = '{CLASS}' UNION SELECT c.id FROM tag_class c JOIN below b ON c.is_subclass_of = b.id)
      SELECT c.creator AS person_id, first_name AS person_first_name, last_name AS person_last_name, string_agg(DISTINCT tag.name, ';' ORDER BY tag.name DESC) AS tag_names, count(DISTINCT c.id) AS reply_count FROM comment c JOIN replier ON true JOIN knows k ON k.src = replier.p AND k.dst = c.creator
      JOIN post ON post.id = c.reply_of_post JOIN post_has_tag t ON t.src = post.id JOIN tag ON tag.id = t.dst JOIN below ON below.id = tag.has_type JOIN person ON person.id = c.creator GROUP BY 1, 2, 3 ORDER BY 5 DESC, 1 LIMIT 20""")
      .replace("friends AS (", "replier AS (SELECT k.src AS p FROM knows k JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = k.dst GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 1), friends AS ("),
    "ic13": _sql(f", {_PATH_WALK} SELECT CAST(coalesce((SELECT d FROM goal), -1) AS INTEGER) AS shortest_path_length"),
    "ic14": _sql(f""", {_PATH_WALK}, {_WEIGHTS}, path AS (SELECT [q] AS path, q AS head, d, CAST(0 AS DOUBLE) AS w FROM goal UNION ALL
      SELECT list_prepend(k.src, path), k.src, path.d - 1, w + coalesce((SELECT weight FROM weights WHERE p1 = least(k.src, k.dst) AND p2 = greatest(k.src, k.dst)), 0) FROM path JOIN knows k ON k.dst = path.head JOIN level l ON l.v = k.src AND l.d = path.d - 1)
      SELECT array_to_string(path, ',') AS person_ids_in_path, w AS path_weight FROM path WHERE d = 0"""),
    "is1": _sql("SELECT first_name, last_name, birthday, location_ip, browser_used, place AS city_id, gender, creation_date FROM person, me WHERE id = p"),
    "is2": _sql("""SELECT m.id AS message_id, m.content AS message_content, m.creation_date AS message_creation_date, post.id AS original_post_id, a.id AS original_post_author_id, a.first_name AS original_post_author_first_name, a.last_name AS original_post_author_last_name
      FROM message m JOIN writer ON m.creator = writer.p JOIN root ON root.id = m.id JOIN post ON post.id = root.root_post JOIN person a ON a.id = post.creator ORDER BY m.creation_date DESC, m.id LIMIT 10""").replace("WITH RECURSIVE ", "WITH RECURSIVE writer AS (SELECT user_id AS p FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "),
    "is3": _sql("SELECT dst AS person_id, first_name, last_name, k.creation_date AS friendship_creation_date FROM knows k JOIN me ON src = p JOIN person ON person.id = dst"),
    "is4": _sql("SELECT creation_date AS message_creation_date, content AS message_content FROM message, someone WHERE id = m"),
    "is5": _sql("SELECT creator AS person_id, first_name, last_name FROM message JOIN someone ON id = m JOIN person ON person.id = creator"),
    "is6": _sql("SELECT forum.id AS forum_id, title AS forum_title, moderator AS moderator_id, first_name AS moderator_first_name, last_name AS moderator_last_name FROM root JOIN someone ON id = m JOIN post ON post.id = root_post JOIN forum ON forum.id = post.forum JOIN person ON person.id = moderator"),
    "is7": _sql("""SELECT c.id AS comment_id, c.content AS comment_content, c.creation_date AS comment_creation_date, c.creator AS reply_author_id, first_name AS reply_author_first_name, last_name AS reply_author_last_name,
      c.creator IN (SELECT dst FROM knows WHERE src = o.creator) AS is_known FROM answered JOIN comment o ON o.id = m JOIN comment c ON c.reply_of_comment = o.id JOIN person ON person.id = c.creator"""),
}
