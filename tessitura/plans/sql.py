"""The queries as DuckDB SQL over the fixture tables."""

TRACKS = """tracks AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title,
         CASE WHEN p_partkey % 4 = 0 THEN [p_brand, p_type] ELSE [p_brand] END AS artists,
         p_type AS album_id, (p_retailprice * 1000) / 1000.0 AS duration, p_size % 10 <> 0 AS available
  FROM part)"""

LISTENED = """listened AS (
  SELECT event_id, user_id AS account, json_extract_string(props, '$.k') AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) AS tm, value AS seconds, event_type,
         CASE event_type WHEN 'error' THEN 'manual-skip' WHEN 'click' THEN 'finished' WHEN 'purchase' THEN 'finished'
                         WHEN 'view' THEN 'source-change' WHEN 'signup' THEN 'stop' END AS cause
  FROM events)"""

LIKES = """like_rows AS (
  SELECT o_custkey AS account, l_partkey, max(ROW(o_orderdate, o_orderkey, l_suppkey)) AS last
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
likes AS (
  SELECT account, row_number() OVER (PARTITION BY account ORDER BY struct_extract(last, 1) DESC, struct_extract(last, 2) DESC, l_partkey) - 1 AS pos,
         CAST(l_partkey AS VARCHAR) || ':' || CAST(struct_extract(last, 3) AS VARCHAR) AS full_id, CAST(l_partkey AS VARCHAR) AS id
  FROM like_rows)"""

STATIONS = """stations AS (
  SELECT ['genre', 'mood', 'activity', 'genre', 'other'][n_regionkey + 1] || ':' || lower(n_name) AS id,
         CASE WHEN n_nationkey % 2 = 0 THEN ['genre:children', 'genre:folk', '', 'genre:rock', ''][n_regionkey + 1] ELSE '' END AS parent_id,
         array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, n_nationkey AS pos
  FROM nation JOIN region ON n_regionkey = r_regionkey),
station_rows AS (
  SELECT id, parent_id, title, pos,
    CASE WHEN id IN ('genre:children','genre:childrens','genre:kids','genre:lullaby','activity:children') OR parent_id IN ('genre:children','genre:childrens','genre:kids','genre:lullaby','activity:children') THEN 'KIDS'
         WHEN id IN ('genre:folk','genre:world','genre:ethnic') OR parent_id IN ('genre:folk','genre:world','genre:ethnic') THEN 'WORLD'
         WHEN id IN ('genre:rock','genre:metal','genre:punk') OR parent_id IN ('genre:rock','genre:metal','genre:punk') THEN 'GENRE'
         WHEN split_part(id, ':', 1) = 'genre' THEN 'GENRE' WHEN split_part(id, ':', 1) = 'mood' THEN 'MOOD'
         WHEN split_part(id, ':', 1) = 'activity' THEN 'ACTIVITY' ELSE 'OTHER' END AS "group",
    CASE WHEN id IN ('genre:children','genre:childrens','genre:kids','genre:lullaby','activity:children') OR parent_id IN ('genre:children','genre:childrens','genre:kids','genre:lullaby','activity:children') THEN 'children'
         WHEN id IN ('genre:folk','genre:world','genre:ethnic') OR parent_id IN ('genre:folk','genre:world','genre:ethnic') THEN 'world'
         WHEN id IN ('genre:rock','genre:metal','genre:punk') OR parent_id IN ('genre:rock','genre:metal','genre:punk') THEN 'guitar'
         WHEN split_part(id, ':', 1) = 'mood' THEN 'mood' WHEN split_part(id, ':', 1) = 'activity' THEN 'activity' ELSE 'music' END AS icon
  FROM stations)"""

PREFERENCES = f"""{STATIONS}, {LISTENED},
recent AS (SELECT account, s.id, count(*) AS count, max(tm) AS last FROM listened l JOIN stations s ON l.k % 25 = s.pos GROUP BY ALL),
users AS (SELECT DISTINCT account FROM listened),
pins AS (SELECT account, s.id, i AS pos FROM users, (VALUES (0), (1)) v(i) JOIN stations s ON true WHERE s.pos = (account + i * 3) % 25),
hidden AS (SELECT account, s.id FROM users JOIN stations s ON s.pos = (account + 3) % 25)"""

ALBUM = """flat AS (
  SELECT l_orderkey AS album_id, l_linenumber, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS disc,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS position FROM lineitem),
album AS (
  SELECT album_id, disc, position, CAST(l_partkey AS VARCHAR) AS id,
         CASE WHEN max(disc) OVER (PARTITION BY album_id) > 1 THEN 'DISC ' || disc ELSE '' END AS section,
         disc || ':' || position || ':' || l_partkey AS key FROM flat)"""

CHANGES = f"""{LIKES},
changes AS (
  SELECT user_id AS account, event_id AS seq, CASE WHEN k % 17 = 0 THEN 'x:1' ELSE CAST(k + 1 AS VARCHAR) END AS track_id,
         CASE WHEN k % 2 = 0 THEN CAST(k + 500 AS VARCHAR) END AS album_id, event_type <> 'error' AS liked,
         CASE WHEN k % 10 = 0 THEN 'failed' WHEN k % 10 = 1 THEN 'pending' ELSE 'confirmed' END AS status
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
valid AS (SELECT *, split_part(track_id, ':', 1) AS base FROM changes WHERE regexp_full_match(track_id, '[0-9]+(:[0-9]+)?'))"""

QUEUE = f"""{TRACKS},
ids AS (
  SELECT l_orderkey AS seq_id, CAST(l_partkey % 40 AS VARCHAR) || ':' || CAST(l_suppkey % 3 AS VARCHAR) AS full_id, l_linenumber FROM lineitem),
placed AS (SELECT seq_id, full_id, row_number() OVER (PARTITION BY seq_id ORDER BY l_linenumber, full_id) AS pos FROM ids),
firsts AS (SELECT seq_id, full_id, min(pos) AS pos FROM placed GROUP BY ALL),
numbered AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS pos, full_id, split_part(full_id, ':', 1) AS id FROM firsts),
queue AS (
  SELECT seq_id, pos, full_id, n.id, coalesce(t.title, 'TRACK ' || n.id) AS title, coalesce(t.available, true) AS available,
         max(pos) OVER (PARTITION BY seq_id, n.id) AS base_pos
  FROM numbered n LEFT JOIN (SELECT * FROM tracks WHERE CAST(id AS INTEGER) % 3 <> 0) t ON n.id = t.id),
cur AS (SELECT seq_id, CAST(floor(count(*) / 3) AS INTEGER) AS cur FROM queue GROUP BY seq_id)"""

HEARD = f"""{LISTENED},
heard AS (SELECT account, id, max(tm) AS tm, min(event_id) AS first FROM listened WHERE seconds > 0 GROUP BY ALL),
last_track AS (SELECT account, id FROM heard QUALIFY row_number() OVER (PARTITION BY account ORDER BY tm DESC, first) = 1),
skips AS (SELECT account, id, count(*) AS skips FROM listened WHERE cause = 'manual-skip' AND seconds < 30 GROUP BY ALL),
rating_changes AS (
  SELECT * FROM (SELECT account, id, tm, event_id, CASE WHEN event_type = 'click' AND k % 5 = 0 THEN 1 WHEN event_type = 'view' AND k % 5 = 0 THEN -1
    WHEN event_type = 'error' AND k % 7 = 0 THEN -2 WHEN event_type = 'signup' THEN 0 END AS value FROM listened) WHERE value IS NOT NULL),
rated AS (
  SELECT account, id, value, tm, event_id FROM (SELECT * FROM rating_changes QUALIFY row_number() OVER (PARTITION BY account, id ORDER BY tm DESC, event_id DESC) = 1)
  WHERE value <> 0 QUALIFY row_number() OVER (PARTITION BY account ORDER BY tm DESC, event_id DESC) <= 2000)"""

MIX = f"""{TRACKS}, {HEARD},
liked AS (SELECT account, id FROM listened WHERE event_type = 'purchase' GROUP BY ALL),
pool AS (SELECT account, id FROM liked UNION SELECT account, id FROM listened WHERE event_type = 'signup'),
start AS (SELECT account, id, row_number() OVER (PARTITION BY account ORDER BY md5('42:' || id), id) AS draw FROM pool QUALIFY draw <= 60),
seed_rows AS (SELECT account, 0 AS source, draw AS tm, t.*, 'seed' AS "from" FROM start JOIN tracks t USING (id)),
artist_of AS (SELECT account, tm, unnest(artists) AS artist_id, generate_subscripts(artists, 1) AS k FROM seed_rows),
two AS (
  SELECT account, artist_id, row_number() OVER (PARTITION BY account ORDER BY first, artist_id) AS n
  FROM (SELECT account, artist_id, min(ROW(tm, k)) AS first FROM artist_of GROUP BY ALL) QUALIFY n <= 2),
one AS (
  SELECT account, album_id FROM (SELECT account, album_id, min(tm) AS first FROM seed_rows GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY account ORDER BY first, album_id) = 1),
lead_rows AS (SELECT *, unnest(artists) AS artist_id FROM tracks),
top AS (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY length(id), id) AS tm FROM lead_rows QUALIFY tm <= 20),
on_album AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY length(id), id) AS tm FROM tracks QUALIFY tm <= 40),
sources AS (
  SELECT account, source, tm, id, artists, available, "from" FROM seed_rows
  UNION ALL SELECT account, n, tm, id, artists, available, 'artist' FROM two JOIN top USING (artist_id)
  UNION ALL SELECT account, 3, tm, id, artists, available, 'album' FROM one JOIN on_album USING (album_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY source, tm) - 1 AS pos FROM sources),
cands AS (
  SELECT p.account, p.pos, p.id, CASE WHEN l.id IS NOT NULL THEN 'liked' ELSE p."from" END AS origin, p.artists, p.available, l.id IS NOT NULL AS liked
  FROM placed p LEFT JOIN liked l ON p.account = l.account AND p.id = l.id),
familiar AS (SELECT account, list(DISTINCT artist) AS artists FROM (SELECT account, unnest(artists) AS artist FROM cands WHERE liked OR origin = 'seed') GROUP BY account),
eligible AS (
  SELECT c.* FROM cands c ANTI JOIN (SELECT account, id FROM rated WHERE value = -2) v USING (account, id)),
eligible2 AS (
  SELECT e.* FROM eligible e ANTI JOIN last_track t USING (account, id) WHERE pos < 180 AND available
  QUALIFY row_number() OVER (PARTITION BY account, id ORDER BY pos) = 1),
features AS (
  SELECT e.account, e.id, e.pos, e.origin, e.artists, e.liked, coalesce(r.value, 0) AS vote,
         (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - h.tm) / 86400000000.0 AS age, coalesce(s.skips, 0) AS skips,
         coalesce(list_has_any(e.artists, f.artists), false) AS familiar
  FROM eligible2 e LEFT JOIN (SELECT * FROM rated WHERE value <> -2) r ON e.account = r.account AND e.id = r.id
  LEFT JOIN heard h ON e.account = h.account AND e.id = h.id LEFT JOIN skips s ON e.account = s.account AND e.id = s.id
  LEFT JOIN familiar f ON e.account = f.account),
scored AS (
  SELECT account, id, artists,
    round(CASE WHEN liked THEN 2 * (1 - 0.4::DOUBLE) ELSE 2 * 0.4::DOUBLE END + 3.0::DOUBLE * vote - 0.2::DOUBLE * least(skips, 3) + CASE WHEN familiar THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END
      + coalesce(0.5::DOUBLE * least(age / 30.0::DOUBLE, 1.0::DOUBLE) - 2.0::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - age), 0.0::DOUBLE)
      + 0.2::DOUBLE * (('0x' || substr(md5('42:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE), 9) AS score,
    CASE WHEN liked AND coalesce(age, -1.0) >= 7 THEN 'LIKED_STALE' WHEN liked THEN 'LIKED' WHEN origin = 'artist' THEN 'KNOWN_ARTIST'
         WHEN origin = 'album' THEN 'SEED_ALBUM' ELSE 'SEED_TRACK' END AS reason
  FROM features),
ranked AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY score DESC, id) AS rank FROM scored)"""

LIKE_LOG = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('view', 'click', 'error')),
log AS (
  SELECT user_id AS account, CAST(k AS VARCHAR) AS base, event_type <> 'error' AS liked, event_id * 200 + 100 AS seq, 'begin' AS step FROM e
  UNION ALL SELECT user_id, CAST(k AS VARCHAR), event_type <> 'error', event_id * 200 + 101 + (k * 331) % 10000 * 2, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'ok' END FROM e)"""

FINDINGS = r"""rules AS (SELECT * FROM (VALUES ('KEYWORD', '(?i)(?:password|token|secret|api_key)\s*[:=]\s*[^\s]{4,}'), ('ACCESS_KEY', '\bAKIA[A-Z0-9]{12,}'),
  ('OAUTH_TOKEN', '\b(?:y[01]_|gh[pousr]_|github_pat_)[A-Za-z0-9_-]{24,}'), ('PRIVATE_KEY', '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'),
  ('JWT', '\beyJ[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{15,}\.[A-Za-z0-9_-]{15,}'),
  ('CREDENTIAL', '(?i)(?:access_token|refresh_token|device_code|user_code|password|cookie|authorization)["'']?\s*[:=]\s*["''][^"''\r\n]{4,}["'']'),
  ('SIGNED_AUDIO', 'https?://[^\s"<>]+(?:/get-mp3/|/get-opus/|[?&](?:sign|signature|token|expires)=)[^\s"<>]+')) r(category, rule)),
pieces AS (SELECT doc_id, category, regexp_extract_all(text, rule) AS inside, string_split_regex(text, rule) AS outside FROM documents, rules WHERE regexp_matches(text, rule)),
findings AS (
  SELECT doc_id, category, 1 + len(string_split(array_to_string(list_transform(range(1, i + 1), lambda j: outside[j] || CASE WHEN j < i THEN inside[j] ELSE '' END), ''), chr(10))) - 1 AS line
  FROM pieces, LATERAL unnest(range(1, len(inside) + 1)) u(i))"""

SQL = {
    "track_projection": f"WITH {TRACKS} SELECT id, title, array_to_string(artists, ', ') AS artist, array_to_string(artists, ', ') AS detail, album_id, album_id AS album_title, duration, available, 'track' AS kind, array_to_string(artists, '|') AS artist_ids FROM tracks",
    "artist_links": f"WITH {TRACKS} SELECT id, generate_subscripts(artists, 1) - 1 AS n, unnest(artists) AS artist_id, unnest(artists) AS title FROM tracks",
    "entity_union": """SELECT p_brand AS id, 'artist' AS kind, p_brand AS title, min(p_type) AS detail, '' AS year, 0.0::DOUBLE AS duration, true AS available FROM part GROUP BY p_brand
        UNION ALL SELECT p_type, 'album', p_type, min(p_brand), CAST(max(p_size) AS VARCHAR), 0.0, true FROM part GROUP BY p_type""",
    "search_sections": """WITH found AS (SELECT * FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_type), 'small') OR contains(lower(p_brand), 'brand#1')),
        t AS (SELECT CAST(p_partkey AS VARCHAR) AS id, max(p_name) AS title, min(p_partkey) AS pos FROM found GROUP BY p_partkey),
        a AS (SELECT p_brand AS id, max(p_brand) AS title, min(p_partkey) AS pos FROM found GROUP BY p_brand),
        b AS (SELECT p_type AS id, max(p_type) AS title, min(p_partkey) AS pos FROM found GROUP BY p_type)
        SELECT 0 AS section_ord, 'BEST' AS section, 'track' AS kind, id, title, 1 AS rank FROM (SELECT * FROM t ORDER BY pos LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 1, 'TRACKS', 'track', id, title, row_number() OVER (ORDER BY pos, id) AS r FROM t) WHERE r <= 6
        UNION ALL SELECT * FROM (SELECT 2, 'ARTISTS', 'artist', id, title, row_number() OVER (ORDER BY pos, id) AS r FROM a) WHERE r <= 6
        UNION ALL SELECT * FROM (SELECT 3, 'ALBUMS', 'album', id, title, row_number() OVER (ORDER BY pos, id) AS r FROM b) WHERE r <= 6""",
    "album_flatten": f"WITH {ALBUM} SELECT * FROM album",
    "section_breaks": f"""WITH {ALBUM} SELECT album_id, key, section <> '' AND section IS DISTINCT FROM lag(section) OVER (PARTITION BY album_id ORDER BY disc, position) AS starts_section FROM album""",
    "history_flatten": """WITH t AS (SELECT conv_id AS account, 0 AS day, '2024-01-01' AS date, 0 AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n,
          CASE WHEN role = 'system' THEN 'radio' ELSE 'track' END AS type, CASE WHEN turn % 5 <> 4 THEN conv_id || '-' || turn END AS id, CASE WHEN turn % 3 <> 0 THEN substr(text, 1, 20) END AS title FROM conversations)
        SELECT account, day, date, item, n, id, coalesce(title, 'TRACK ' || id) AS title, title IS NOT NULL AS available FROM t WHERE type = 'track' AND (title IS NOT NULL OR id IS NOT NULL)""",
    "header_text": "SELECT p_partkey, concat_ws(' · ', p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END, CASE WHEN p_size % 3 = 0 THEN 'x' END) AS header FROM part",
    "clock_format": """WITH s AS (SELECT *, CAST(greatest(floor(p_retailprice - 950), 0) AS BIGINT) AS n FROM part)
        SELECT p_partkey, (n // 60) || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') AS clock, CAST(trunc(p_retailprice * 1000000) AS BIGINT) AS us,
               CASE WHEN p_size % 7 = 0 THEN 0.0::DOUBLE ELSE p_size / 100.0::DOUBLE END AS volume, CASE p_brand WHEN 'Brand#11' THEN 'one' WHEN 'Brand#12' THEN 'two' ELSE '' END AS label FROM s""",
    "playback_status": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN k % 11 = 0 THEN 'loading' WHEN k % 7 = 0 THEN 'empty' WHEN event_type = 'signup' THEN 'stopped'
        WHEN k % 3 = 0 THEN 'paused' WHEN k % 5 = 0 THEN 'buffering' ELSE 'playing' END AS status FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "property_metadata": """SELECT p_partkey, 'title' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 'album', p_type FROM part WHERE p_size % 2 = 0
        UNION ALL SELECT p_partkey, 'length', CAST(CAST(p_size AS BIGINT) * 1000000 AS VARCHAR) FROM part""",
    "station_classify": f"WITH {STATIONS} SELECT * FROM station_rows",
    "station_search": f"""WITH {STATIONS} SELECT id, title, "group" FROM station_rows WHERE contains(lower(title), 'ion_1')""",
    "recent_stations": f"WITH {PREFERENCES} SELECT account, id, count, last AS last_us FROM recent",
    "station_groups": f"""WITH {PREFERENCES},
        facts AS (SELECT u.account, s.id, s.pos, s."group", p.pos AS pin, h.id IS NOT NULL AS hide, r.last, r.count FROM users u JOIN station_rows s ON true
          LEFT JOIN pins p ON p.account = u.account AND p.id = s.id LEFT JOIN hidden h ON h.account = u.account AND h.id = s.id LEFT JOIN recent r ON r.account = u.account AND r.id = s.id),
        tops AS (SELECT *, pin IS NOT NULL AND NOT hide AS pinned, last IS NOT NULL AND NOT hide AND NOT (pin IS NOT NULL AND NOT hide) AS cand FROM facts),
        ranks AS (SELECT *, CASE WHEN cand THEN row_number() OVER (PARTITION BY account, cand ORDER BY last DESC, count DESC, pos) END AS rr FROM tops),
        placed AS (SELECT account, id, CASE WHEN pinned THEN 0 WHEN rr <= 8 THEN 1 ELSE list_position(['KIDS', 'WORLD', 'GENRE', 'MOOD', 'ACTIVITY', 'OTHER'], "group") + 1 END AS group_ord,
          CASE WHEN pinned THEN 'PINNED' WHEN rr <= 8 THEN 'RECENT' ELSE "group" END AS "group", CASE WHEN pinned THEN pin WHEN rr <= 8 THEN rr ELSE pos END AS tm FROM ranks)
        SELECT account, group_ord, "group", row_number() OVER (PARTITION BY account, group_ord ORDER BY tm, id) AS rank, id FROM placed""",
    "grid_chunks": f"""WITH {STATIONS}, n AS (SELECT "group", id, row_number() OVER (PARTITION BY "group" ORDER BY pos) - 1 AS n FROM station_rows)
        SELECT "group", n // 4 AS line, string_agg(id, ',' ORDER BY n) AS ids FROM n GROUP BY ALL""",
    "url_allowlist": """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN 'https://user@the.example.com/' || page_id
          WHEN 2 THEN '//the.example.com/%%/' || page_id ELSE 'https://and.example.com:' || CASE WHEN page_id % 8 = 3 THEN '443' ELSE '8443' END || '/a' END AS raw FROM pages),
        f AS (SELECT page_id, replace(CASE WHEN starts_with(raw, 'https://') THEN raw ELSE 'https://' || regexp_replace(raw, '^/+', '') END, '%%', '300x300') AS url FROM u),
        p AS (SELECT *, regexp_extract(url, '^https://([^/?#]*)', 1) AS authority FROM f)
        SELECT page_id, CASE WHEN lower(regexp_replace(authority, ':[0-9]*$', '')) IN ('therha.example.com', 'the.example.com', 'and.example.com', 'on.example.com', 'm.ththth.example.net')
          AND NOT contains(authority, '@') AND NOT contains(url, '?') AND NOT contains(url, '#') AND regexp_extract(authority, ':([0-9]*)$', 1) IN ('', '443') THEN url ELSE '' END AS url FROM p""",
    "id_validation": """WITH f AS (SELECT *, CASE p_size % 3 WHEN 0 THEN p_partkey || ':7' WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE p_partkey || ':' END AS full_id FROM part)
        SELECT p_partkey, regexp_full_match(full_id, '[0-9]+(:[0-9]+)?') AS track_id, p_size % 2 = 0 AS entity_id, split_part(full_id, ':', 1) AS base, p_size % 4 = 0 AS commit_id FROM f""",
    "http_error_class": """WITH s AS (SELECT CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE [400, 401, 403, 404, 408, 429, 500, 503][l_partkey % 8 + 1] END AS status, ['network', 'timeout', 'bad_request', 'not_found', 'tls'][l_linenumber % 5 + 1] AS kind FROM lineitem)
        SELECT CASE WHEN status = 401 THEN 'INVALID_ACCOUNT' WHEN status = 403 THEN 'FORBIDDEN' WHEN kind = 'bad_request' THEN 'REJECTED' WHEN kind = 'not_found' THEN 'NOT_FOUND' WHEN status = 429 THEN 'RATE_LIMITED'
          WHEN status BETWEEN 500 AND 599 THEN 'SERVER' WHEN status BETWEEN 400 AND 499 THEN 'CLIENT' WHEN kind = 'timeout' THEN 'TIMEOUT' WHEN kind = 'network' THEN 'NETWORK' ELSE 'OTHER' END AS class,
          coalesce(kind = 'timeout' OR status IN (408, 500, 502, 503, 504) OR (kind = 'network' AND status IS NULL), false) AS transient, count(*) AS n FROM s GROUP BY ALL""",
    "best_variant": """WITH v AS (SELECT l_orderkey AS id, l_linenumber * 1000000 + l_partkey AS pos, CASE l_returnflag WHEN 'A' THEN 'mp3' WHEN 'N' THEN 'aac' ELSE 'flac' END AS codec, l_linestatus = 'O' AS preview, l_quantity AS bitrate FROM lineitem)
        SELECT id, bitrate, pos, codec FROM v WHERE NOT preview AND codec IN ('mp3', 'aac') QUALIFY row_number() OVER (PARTITION BY id ORDER BY bitrate DESC, pos, codec DESC) = 1""",
    "truncated_media": """SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_quantity AS v, l_quantity * (1 + l_discount * 2) AS e FROM lineitem) WHERE v <> 0 AND e <> 0 AND v < 0.95::DOUBLE * e AND e - v > 5 GROUP BY l_orderkey""",
    "likes_page": f"""WITH {LIKES}, {TRACKS} SELECT account, pos, full_id, l.id, coalesce(t.title, 'TRACK ' || l.id) AS title, coalesce(array_to_string(t.artists, ', '), '') AS artist, coalesce(t.duration, 0.0) AS duration, coalesce(t.available, false) AS available
        FROM likes l LEFT JOIN (SELECT * FROM tracks WHERE CAST(id AS BIGINT) % 9 <> 0) t ON l.id = t.id WHERE pos >= 50 AND pos < 100""",
    "likes_totals": f"WITH {LIKES} SELECT account, count(*) AS total, count(*) FILTER (pos >= 50 AND pos < 100) AS loaded, 100 < count(*) AS more FROM likes GROUP BY account",
    "likes_merge": f"""WITH {CHANGES},
        c AS (SELECT *, lag(liked) OVER (PARTITION BY account, base ORDER BY seq) AS before FROM valid WHERE status = 'confirmed'),
        f AS (SELECT c.*, coalesce(c.before, l.id IS NOT NULL) AS present FROM c LEFT JOIN likes l ON c.account = l.account AND c.base = l.id),
        net AS (SELECT account, base, arg_max(liked, seq) AS liked, bool_or(NOT liked) AS removed FROM f GROUP BY ALL),
        newest AS (SELECT account, base, max(seq) AS seq, arg_max(CASE WHEN contains(track_id, ':') THEN track_id WHEN album_id IS NOT NULL THEN base || ':' || album_id ELSE base END, seq) AS full_id FROM f WHERE liked AND NOT present GROUP BY ALL),
        rows AS (SELECT n.account, 0 AS part, -n.seq AS tm, n.full_id FROM newest n JOIN net ON n.account = net.account AND n.base = net.base WHERE net.liked
          UNION ALL SELECT l.account, 1, l.pos, l.full_id FROM likes l LEFT JOIN net ON l.account = net.account AND l.id = net.base WHERE net.removed IS NULL OR NOT net.removed)
        SELECT account, row_number() OVER (PARTITION BY account ORDER BY part, tm, full_id) - 1 AS pos, full_id FROM rows""",
    "likes_pending_overlay": f"""WITH {CHANGES},
        w AS (SELECT account, base, arg_max(liked, seq) AS liked, arg_max(status = 'pending', seq) AS pending FROM valid WHERE status <> 'failed' GROUP BY ALL)
        SELECT coalesce(l.account, w.account) AS account, coalesce(l.id, w.base) AS base, coalesce(w.pending, false) AS pending FROM (SELECT DISTINCT account, id FROM likes) l FULL JOIN w ON l.account = w.account AND l.id = w.base
        WHERE coalesce(w.liked, l.id IS NOT NULL)""",
    "page_merge": """WITH r AS (SELECT l_orderkey AS list_id, l_linenumber // 3 AS page, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey * 100 + l_suppkey AS pos, CASE WHEN l_linenumber = 1 THEN 'k' || (l_partkey % 5) END AS key, CAST(l_partkey % 50 AS VARCHAR) AS id, l_returnflag AS section FROM lineitem),
        u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY list_id, page, pos ORDER BY section) = 1),
        k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY list_id, coalesce(key, 'row|track|' || id || '|' || section) ORDER BY page, pos) = 1)
        SELECT list_id, page, pos, id, section, row_number() OVER (PARTITION BY list_id ORDER BY page, pos) - 1 AS "at" FROM k""",
    "toggle_membership": f"""WITH {LISTENED}, o AS (SELECT account, id AS item, max(event_id) AS last FROM listened GROUP BY ALL HAVING count(*) % 2 = 1)
        SELECT account, item, row_number() OVER (PARTITION BY account ORDER BY last, item) - 1 AS pos FROM o""",
    "ordered_distinct": f"WITH {LISTENED} SELECT account, id, min(event_id) AS event_id FROM listened GROUP BY ALL",
    "queue_build": f"WITH {QUEUE} SELECT * FROM queue",
    "queue_rows": f"WITH {QUEUE} SELECT seq_id, pos, id, pos = cur AS is_current FROM queue JOIN cur USING (seq_id) WHERE pos >= cur",
    "queue_neighbours": f"""WITH {QUEUE} SELECT seq_id, pos, coalesce(first_value(CASE WHEN available THEN pos END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_pos,
        coalesce(last_value(CASE WHEN available THEN pos END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS previous_pos FROM queue""",
    "queue_restore": f"WITH {QUEUE} SELECT seq_id, pos, id, row_number() OVER (PARTITION BY seq_id ORDER BY pos > cur, CASE WHEN pos > cur THEN base_pos ELSE pos END, pos) - 1 AS new_pos FROM queue JOIN cur USING (seq_id)",
    "queue_shuffle": f"WITH {QUEUE} SELECT seq_id, pos, id, row_number() OVER (PARTITION BY seq_id ORDER BY pos > cur, CASE WHEN pos > cur THEN md5('42:' || full_id) END NULLS FIRST, pos) - 1 AS new_pos FROM queue JOIN cur USING (seq_id)",
    "queue_wrap": f"""WITH {QUEUE}, d AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY md5('42:' || full_id), pos) - 1 AS drawn FROM queue JOIN cur USING (seq_id)),
        h AS (SELECT *, max(CASE WHEN drawn = 0 AND pos = cur THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id) AS head, count(*) OVER (PARTITION BY seq_id) AS size FROM d)
        SELECT seq_id, pos, id, CASE WHEN head = 1 AND size > 1 THEN (drawn - 1 + size) % size ELSE drawn END AS new_pos FROM h""",
    "queue_start": f"""WITH {QUEUE}, w AS (SELECT seq_id, id AS wanted, seq_id % 2 = 0 AS shuffled FROM queue WHERE pos = 1),
        f AS (SELECT q.*, CASE WHEN shuffled THEN 0 ELSE coalesce(min(CASE WHEN id = wanted THEN pos END) OVER (PARTITION BY seq_id), 0) END AS from_pos FROM queue q JOIN w USING (seq_id))
        SELECT seq_id, coalesce(min(pos) FILTER (available AND pos >= from_pos), -1) AS start_pos FROM f GROUP BY seq_id""",
    "queue_window": f"WITH {QUEUE} SELECT seq_id, pos, id FROM queue JOIN cur USING (seq_id) WHERE pos > cur AND pos <= cur + 2 AND CAST(id AS INTEGER) % 2 = 0",
    "queue_refresh": f"""WITH {QUEUE} SELECT seq_id, pos, q.id, coalesce(t.title, q.title) AS title, coalesce(t.available, q.available) AS available FROM queue q LEFT JOIN (SELECT * FROM tracks WHERE CAST(id AS INTEGER) % 3 = 0) t ON q.id = t.id""",
    "queue_extend": f"""WITH {QUEUE}, q AS (SELECT seq_id, pos, id FROM queue QUALIFY row_number() OVER (PARTITION BY seq_id, id ORDER BY pos) = 1),
        r AS (SELECT seq_id - 1 AS seq_id, min(pos) AS pos, id FROM queue WHERE available GROUP BY ALL),
        f AS (SELECT * FROM r ANTI JOIN q USING (seq_id, id)), s AS (SELECT seq_id, max(pos) + 1 AS size FROM q GROUP BY seq_id)
        SELECT * FROM q UNION ALL SELECT f.seq_id, coalesce(size, 0) + row_number() OVER (PARTITION BY f.seq_id ORDER BY f.pos) - 1, f.id FROM f LEFT JOIN s ON f.seq_id = s.seq_id""",
    "history_positions": f"""WITH {QUEUE}, h AS (SELECT seq_id, pos AS tm, CASE WHEN pos % 2 = 0 THEN id ELSE 'none' END AS id FROM queue), m AS (SELECT seq_id, id, min(pos) AS pos FROM queue GROUP BY ALL)
        SELECT h.seq_id, h.tm AS "at", h.id, coalesce(m.pos, -1) AS pos FROM h LEFT JOIN m ON h.seq_id = m.seq_id AND h.id = m.id""",
    "history_fold": f"""WITH RECURSIVE {LISTENED},
        a AS (SELECT account AS seq_id, row_number() OVER (PARTITION BY account ORDER BY event_id) AS n, CASE WHEN event_type IN ('view', 'click') THEN 'start' WHEN event_type = 'error' THEN 'previous' ELSE 'forward' END AS action, CASE WHEN event_type IN ('view', 'click') OR CAST(id AS INTEGER) % 3 <> 0 THEN id END AS id FROM listened WHERE event_type <> 'purchase'),
        f AS (SELECT DISTINCT seq_id, 0::BIGINT AS n, []::VARCHAR[] AS h, -1::BIGINT AS c FROM a
          UNION ALL SELECT f.seq_id, a.n, CASE WHEN action = 'start' THEN list_append(h[:c + 1], a.id) WHEN action = 'previous' AND c <= 0 AND a.id IS NOT NULL THEN list_prepend(a.id, h) ELSE h END,
            CASE WHEN action = 'start' THEN c + 1 WHEN action = 'previous' AND c > 0 THEN c - 1 WHEN action = 'previous' AND a.id IS NOT NULL THEN 0 WHEN action = 'forward' AND c + 1 < len(h) THEN c + 1 ELSE c END
          FROM f JOIN a ON a.seq_id = f.seq_id AND a.n = f.n + 1)
        SELECT seq_id, array_to_string(h, ',') AS history, c AS cursor FROM f QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY n DESC) = 1""",
    "advance_decision": """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT event_id, CASE WHEN k % 2 = 0 AND k % 3 = 1 THEN 'REPLAY' WHEN k % 2 <> 0 AND k % 5 = 0 THEN 'HISTORY' WHEN k % 7 >= 3 THEN 'NEXT' WHEN k % 3 = 2 THEN 'WRAP' ELSE 'STOP' END AS step FROM e""",
    "last_heard": f"WITH {HEARD} SELECT account, id, tm AS at_us FROM heard",
    "last_track": f"WITH {HEARD} SELECT * FROM last_track",
    "skip_counts": f"WITH {HEARD} SELECT * FROM skips",
    "rating_lww": f"WITH {HEARD} SELECT account, id, value, tm AS at_us FROM rated",
    "retention": f"""WITH {LISTENED} SELECT account, event_id, tm AS at_us FROM listened WHERE account % 5 <> 0 AND tm >= epoch_us(TIMESTAMP '2024-01-21 00:00:00')
        QUALIFY row_number() OVER (PARTITION BY account ORDER BY tm DESC, event_id DESC) <= 12""",
    "listening_time": f"""WITH {LISTENED}, g AS (SELECT account, (tm - lag(tm) OVER w) / 1e6::DOUBLE AS gap, lag(event_type IN ('view', 'click')) OVER w AS was FROM listened WINDOW w AS (PARTITION BY account ORDER BY tm, event_id))
        SELECT account, CAST(sum(CASE WHEN was THEN CAST(trunc(least(greatest(gap, 0.0), 43200.0) * 1000) AS BIGINT) ELSE 0 END) AS BIGINT) AS milliseconds, count(*) FILTER (was AND gap IS NOT NULL) AS intervals FROM g GROUP BY account""",
    "event_dedup": f"""WITH {LISTENED} SELECT account, id || '-' || (event_id // 40) AS play, event_id FROM listened QUALIFY row_number() OVER (PARTITION BY account, id || '-' || (event_id // 40) ORDER BY tm, event_id) = 1""",
    "play_sessions": f"""WITH {LISTENED}, s AS (SELECT account, tm, event_id, CASE WHEN event_type IN ('view', 'purchase') THEN 'started' WHEN event_type = 'click' THEN 'finished' WHEN event_type = 'error' THEN 'error' ELSE 'stop' END AS signal FROM listened),
        n AS (SELECT *, lead(tm) OVER w AS next_at, lead(signal) OVER w AS next_signal FROM s WINDOW w AS (PARTITION BY account ORDER BY tm, event_id))
        SELECT account, row_number() OVER (PARTITION BY account ORDER BY tm, event_id) AS session, tm AS began_us, next_at AS ended_us, CASE WHEN next_signal = 'started' THEN 'source-change' ELSE next_signal END AS cause FROM n WHERE signal = 'started'""",
    "batch_counters": """SELECT o_orderpriority AS station, count(DISTINCT o_orderkey) AS received, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS played FROM orders GROUP BY 1""",
    "mix_candidates": f"WITH {MIX} SELECT account, pos, id, origin, available FROM cands",
    "mix_features": f"WITH {MIX} SELECT account, id, pos, origin, liked, vote, round(age, 6) AS age, skips, familiar FROM features",
    "mix_ranked": f"WITH {MIX} SELECT account, rank, id, score, reason FROM ranked",
    "mix_greedy": f"""WITH RECURSIVE {MIX},
        pools AS (SELECT account, list({{'id': id, 'score': score, 'artists': artists, 'reason': reason}} ORDER BY rank) AS remaining FROM ranked GROUP BY account),
        picks AS (SELECT account, remaining, []::VARCHAR[] AS used, []::VARCHAR[] AS last, 0 AS pick, NULL::STRUCT(id VARCHAR, score DOUBLE, artists VARCHAR[], reason VARCHAR) AS best FROM pools
          UNION ALL SELECT account, list_filter(remaining, lambda x: x.id <> b.id), list_concat(used, b.artists), b.artists, pick + 1, b
          FROM (SELECT *, list_filter(remaining, lambda r: NOT list_has_any(r.artists, last) AND len(list_filter(r.artists, lambda a: len(list_filter(used, lambda u: u = a)) >= 3)) = 0)[1] AS b FROM picks WHERE pick < 30) WHERE b IS NOT NULL)
        SELECT account, pick, best.id AS id, best.score AS score, best.reason AS reason FROM picks WHERE pick > 0""",
    "payload_hash": "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents",
    "manifest_lines": "SELECT sha256(html) || '  pages/' || page_id AS line FROM pages",
    "manifest_diff": """SELECT 'd/' || doc_id AS path, CASE doc_id % 10 WHEN 3 THEN 'ADDED' WHEN 4 THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM documents WHERE doc_id % 10 IN (3, 4, 5)""",
    "property_diff": f"""WITH {LISTENED}, n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY tm DESC, event_id DESC) AS n FROM listened QUALIFY n <= 2),
        l AS (SELECT account AS object, n, 'status' AS name, event_type AS value FROM n UNION ALL SELECT account, n, 'track', id FROM n)
        SELECT a.object, a.name, a.value FROM l a LEFT JOIN l b ON b.n = 2 AND a.object = b.object AND a.name = b.name WHERE a.n = 1 AND a.value IS DISTINCT FROM b.value""",
    "private_paths": "SELECT page_id, page_id % 4 > 0 OR page_id % 3 > 0 AS private FROM pages",
    "secret_scan": rf"""WITH {FINDINGS} SELECT doc_id, category, line FROM findings""",
    "audit_counters": rf"""WITH {FINDINGS}, o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'commit' ELSE 'blob' END AS kind, doc_id % 5 <> 0 AND doc_id % 7 = 0 AS image FROM documents),
        n AS (SELECT doc_id, count(*) AS n FROM findings GROUP BY doc_id)
        SELECT kind, count(*) AS scanned, count(*) FILTER (image) AS images, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings FROM o LEFT JOIN n USING (doc_id) GROUP BY kind""",
    "required_missing": "SELECT 'd/' || doc_id AS path FROM documents WHERE doc_id % 2 = 0 AND doc_id % 9 = 4",
    "object_labels": "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND url <> '' THEN url ELSE '(commit metadata)' END AS label FROM pages",
    "round_half_even": """SELECT p_partkey, CAST(format('{:.2f}', p_partkey * 0.005::DOUBLE + p_size) AS DOUBLE) AS price, CAST(format('{:.2f}', (p_partkey - 40) / 8.0::DOUBLE) AS DOUBLE) AS eighths,
        CAST(format('{:.2f}', p_retailprice * 1.005::DOUBLE) AS DOUBLE) AS raised FROM part""",
    "iso_times": f"WITH {LISTENED} SELECT event_id, strftime(make_timestamp(tm), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started FROM listened",
    "derived_state": """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
        s AS (SELECT *, k % 6 = 0 AS wave, ['likes', 'search', 'artist:7', 'album:8'][k % 4 + 1] AS view, ['off', 'one', 'all'][k % 3 + 1] AS repeat FROM e)
        SELECT event_id, CASE view WHEN 'likes' THEN 'LIKES' WHEN 'search' THEN 'SEARCH' ELSE CASE WHEN k % 3 = 0 THEN 'T' || k ELSE 'CATALOGUE' END END AS heading, split_part(view, ':', 1) AS kind,
          k % 5 = 1 OR (k % 2 = 0 AND k % 7 = 0) AS busy, k % 8 <> 0 AND k % 5 NOT IN (2, 3) AS can_pause, k % 9 > 0 AND NOT wave AS finite_queue, CASE WHEN wave THEN 'off' ELSE repeat END AS repeat_mode,
          NOT wave AND k % 2 = 1 AS shuffled, NOT wave AND (k % 4 - 1 > 0 OR k % 5 - 1 >= 0) AS can_previous,
          wave OR k % 4 - 1 < k % 3 - 1 OR (k % 4 <> 0 AND k % 7 = 1) OR (repeat = 'all' AND k % 2 = 0) AS can_next, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS own_rating FROM s""",
    "grid_headings": f"""WITH {STATIONS}, n AS (SELECT "group", id, row_number() OVER (PARTITION BY "group" ORDER BY pos) - 1 AS n FROM station_rows)
        SELECT "group", n // 4 AS line, string_agg(id, ',' ORDER BY n) AS ids FROM n WHERE "group" NOT IN ('WORLD', 'MOOD') GROUP BY ALL UNION ALL SELECT DISTINCT "group", -1, '' FROM station_rows""",
    "artist_pages": f"""WITH {TRACKS}, t AS (SELECT unnest(artists) AS artist_id, id, title FROM tracks),
        r AS (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY length(id), id) - 1 AS pos, count(*) OVER (PARTITION BY artist_id) AS total FROM t)
        SELECT artist_id, id, title, pos, total, 100 < total AS more FROM r WHERE pos >= 50 AND pos < 100""",
    "artist_albums": f"""WITH {TRACKS}, t AS (SELECT DISTINCT unnest(artists) AS artist_id, album_id || '-' || right(id, 1) AS album_id FROM tracks)
        SELECT artist_id, album_id, row_number() OVER (PARTITION BY artist_id ORDER BY album_id) - 1 AS pos, -1 AS total, false AS more FROM t QUALIFY pos < 20""",
    "search_pages": """WITH r AS (SELECT 'track' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS total FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_name), 'e'))
        SELECT kind, id, title, pos, total, 60 < total AS more FROM r WHERE pos >= 40 AND pos < 60""",
    "likes_shown": f"""WITH {LIKE_LOG}
        SELECT account, base, seq, CASE WHEN step = 'failed' THEN NOT l ELSE l END AS shown
        FROM (SELECT *, last_value(CASE WHEN step = 'begin' THEN liked END IGNORE NULLS) OVER (PARTITION BY account, base ORDER BY seq ROWS UNBOUNDED PRECEDING) AS l FROM log)""",
    "likes_refresh": f"""WITH RECURSIVE {LIKE_LOG}, n AS (SELECT account, seq, step, row_number() OVER (PARTITION BY account ORDER BY seq) AS n FROM log),
        f AS (SELECT DISTINCT account, 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS pending, false AS needed, false AS refresh FROM n
          UNION ALL SELECT account, n, seq, p, need AND NOT hit, hit FROM (SELECT *, p <= 0 AND step <> 'begin' AND need AS hit FROM (
            SELECT n.account, n.n, n.seq, n.step, f.pending + CASE WHEN n.step = 'begin' THEN 1 ELSE -1 END AS p, f.needed OR n.step = 'ok' AS need FROM f JOIN n ON n.account = f.account AND n.n = f.n + 1)))
        SELECT account, seq FROM f WHERE refresh""",
    "profile_cleared": f"""WITH {LISTENED}, c AS (SELECT account, max(tm) AS cleared FROM listened WHERE event_type = 'signup' AND CAST(id AS INTEGER) % 4 = 0 GROUP BY account)
        SELECT l.account, count(*) AS events, min(event_id) AS first FROM listened l LEFT JOIN c USING (account) WHERE cleared IS NULL OR tm > cleared GROUP BY l.account""",
    "radio_requests": f"""WITH {LISTENED} SELECT account, 'genre:' || (CAST(id AS INTEGER) % 3) AS station, event_id AS seq, lag(id) OVER w AS previous, row_number() OVER w = 1 AS radio_started
        FROM listened WINDOW w AS (PARTITION BY account, CAST(id AS INTEGER) % 3 ORDER BY event_id)""",
    "radio_batches": """WITH r AS (SELECT 's' || (conv_id % 7) AS station, conv_id AS batch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, turn FROM conversations)
        SELECT station, batch, pos, batch || '-' || turn AS track FROM r WHERE role <> 'system' AND turn % 4 <> 3""",
    "wave_dedup_stream": f"""WITH RECURSIVE {LISTENED},
        s AS (SELECT account, 'genre:' || (CAST(id AS INTEGER) % 3) AS station, event_id AS seq, CASE WHEN event_type IN ('click', 'error') THEN 'play' ELSE 'offer' END AS action, CAST(event_id // 50 AS VARCHAR) AS batch,
          CAST(CAST(id AS INTEGER) % 12 AS VARCHAR) AS track, CAST(id AS INTEGER) % 13 <> 0 AS available FROM listened),
        n AS (SELECT *, row_number() OVER (PARTITION BY account, station ORDER BY seq) AS n FROM s),
        f AS (SELECT DISTINCT account, station, 0::BIGINT AS n, []::VARCHAR[] AS q, []::VARCHAR[] AS p, false AS hit FROM n
          UNION ALL SELECT account, station, n,
            CASE WHEN NOT ok THEN q WHEN action = 'offer' THEN list_append(q, track) ELSE list_filter(q, lambda x: x <> track) END,
            CASE WHEN ok AND action = 'play' THEN list_append(list_filter(p, lambda x: x <> track), track)[-3:] ELSE p END, ok
          FROM (SELECT n.account, n.station, n.n, n.action, n.track, f.q, f.p,
              CASE WHEN n.action = 'offer' THEN n.available AND NOT list_contains(f.q, n.track) AND NOT list_contains(f.p, n.track) ELSE list_contains(f.q, n.track) END AS ok
            FROM f JOIN n ON n.account = f.account AND n.station = f.station AND n.n = f.n + 1))
        SELECT account, station, seq, action, batch, track, len(q) AS queued, len(q) <= 2 AS refill FROM f JOIN n USING (account, station, n) WHERE hit""",
    "wave_feedback_stream": f"""WITH RECURSIVE {LISTENED},
        s AS (SELECT account, event_id AS seq, row_number() OVER (PARTITION BY account ORDER BY event_id) AS n, CAST(CAST(id AS INTEGER) % 2 AS VARCHAR) AS track,
          CASE WHEN event_type IN ('view', 'purchase') THEN 'started' WHEN event_type = 'signup' AND CAST(id AS INTEGER) % 4 = 0 THEN 'radio' ELSE cause END AS signal FROM listened),
        f AS (SELECT DISTINCT account, 0::BIGINT AS n, NULL::VARCHAR AS track, 0::BIGINT AS began, true AS ended, []::STRUCT(seq BIGINT, track VARCHAR, event VARCHAR, seconds BIGINT)[] AS found FROM s
          UNION ALL SELECT account, n, CASE WHEN starts THEN new ELSE track END, CASE WHEN starts THEN seq ELSE began END, CASE WHEN starts THEN false ELSE ended OR ends END,
            CASE WHEN signal = 'radio' THEN [{{'seq': seq, 'track': NULL::VARCHAR, 'event': 'radioStarted', 'seconds': 0::BIGINT}}]
              WHEN starts AND NOT ended THEN [{{'seq': seq, 'track': track, 'event': 'skip', 'seconds': seq - began}}, {{'seq': seq, 'track': new, 'event': 'trackStarted', 'seconds': 0::BIGINT}}]
              WHEN starts THEN [{{'seq': seq, 'track': new, 'event': 'trackStarted', 'seconds': 0::BIGINT}}]
              WHEN ends THEN [{{'seq': seq, 'track': track, 'event': CASE WHEN signal = 'finished' THEN 'trackFinished' ELSE 'skip' END, 'seconds': seq - began}}] ELSE [] END
          FROM (SELECT f.account, s.n, s.seq, s.signal, s.track AS new, f.track, f.began, f.ended,
              s.signal = 'started' AND NOT coalesce(f.track = s.track AND NOT f.ended, false) AS starts,
              s.signal NOT IN ('started', 'radio') AND NOT f.ended AND coalesce(f.track = s.track, false) AS ends
            FROM f JOIN s ON s.account = f.account AND s.n = f.n + 1))
        SELECT account, o.seq AS seq, o.track AS track, o.event AS event, o.seconds AS seconds FROM (SELECT account, unnest(found) AS o FROM f)""",
    "event_dedup_stream": f"WITH {LISTENED} SELECT DISTINCT account, id || '-' || (event_id // 40) AS play FROM listened",
    "stale_results": f"""WITH {LISTENED}, r AS (SELECT account || ':' || event_type AS key, event_id // 100 AS version, event_id FROM listened) SELECT * FROM r QUALIFY version = max(version) OVER (PARTITION BY key)""",
    "accepted_events": """WITH r AS (SELECT l_orderkey AS session, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_partkey % 2 AS entry FROM lineitem),
        a AS (SELECT session, entry AS own, n AS ack FROM r WHERE n = 3),
        j AS (SELECT *, n < ack AS early, row_number() OVER (PARTITION BY session, n < ack ORDER BY n DESC) AS k FROM r JOIN a USING (session))
        SELECT session, n, entry, early AS replayed FROM j WHERE entry = own AND (NOT early OR k <= 1)""",
    "seed_list": f"""WITH {LISTENED}, g AS (SELECT account, id, max(event_id) AS seq FROM listened WHERE event_type = 'signup' GROUP BY ALL),
        l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY account ORDER BY seq DESC, id) <= 10)
        SELECT account, id, row_number() OVER (PARTITION BY account ORDER BY seq, id DESC) - 1 AS pos FROM l""",
    "play_reports": f"""WITH {TRACKS}, {LISTENED}, j AS (SELECT l.id, CASE WHEN CAST(t.id AS INTEGER) % 3 <> 0 THEN t.album_id END AS album_id, t.duration, l.seconds FROM listened l JOIN tracks t ON l.id = t.id)
        SELECT id, CAST(round(duration) AS BIGINT) AS length, coalesce(album_id, '') <> '' AND seconds > 0 AS accepted, count(*) AS n FROM j GROUP BY ALL""",
    "play_sessions_stream": f"""WITH {LISTENED}, s AS (SELECT account, tm, event_id, CASE WHEN event_type IN ('view', 'purchase') THEN 'started' WHEN event_type = 'click' THEN 'finished' WHEN event_type = 'error' THEN 'error' ELSE 'stop' END AS signal FROM listened),
        n AS (SELECT *, lead(tm) OVER w AS next_at, lead(signal) OVER w AS next_signal FROM s WINDOW w AS (PARTITION BY account ORDER BY tm, event_id))
        SELECT account, row_number() OVER (PARTITION BY account ORDER BY tm, event_id) AS session, tm AS began_us, least(next_at, tm + 86400000000) AS ended_us,
          CASE WHEN next_at IS NULL OR next_at > tm + 86400000000 THEN 'timeout' WHEN next_signal = 'started' THEN 'source-change' ELSE next_signal END AS cause FROM n WHERE signal = 'started'""",
    "retention_stream": f"""WITH {LISTENED}, n AS (SELECT *, max(tm) OVER (PARTITION BY account) AS newest FROM listened),
        k AS (SELECT * FROM n WHERE tm >= newest - 2 * 86400000000 QUALIFY row_number() OVER (PARTITION BY account ORDER BY tm DESC, event_id DESC) <= 4),
        g AS (SELECT account, count(*) AS kept, min(tm) AS oldest_us, any_value(newest) + 2 * 86400000000 <= epoch_us(TIMESTAMP '2024-01-31 12:00:00') AS gone FROM k GROUP BY account)
        SELECT account, CAST(CASE WHEN gone THEN 0 ELSE kept END AS INTEGER) AS kept, CASE WHEN NOT gone THEN oldest_us END AS oldest_us FROM g""",
    "stale_results_stream": f"""WITH {LISTENED}, q AS (SELECT CAST(account AS VARCHAR) AS key, event_id * 2 AS seq, event_id AS version FROM listened),
        r AS (SELECT CAST(account AS VARCHAR) AS key, event_id * 2 + 1 + (k * 37) % 400 AS seq, event_id AS version, event_id AS id FROM listened)
        SELECT key, seq, version, id, NOT EXISTS (SELECT 1 FROM q WHERE q.key = r.key AND q.version > r.version AND q.seq <= r.seq) AS current FROM r""",
}
SQL["listening_time_stream"] = SQL["listening_time"]
SQL["accepted_events_stream"] = SQL["accepted_events"]
SQL["batch_counters_stream"] = SQL["batch_counters"]
SQL["history_fold_split"] = SQL["history_fold"]
SQL["likes_store"] = SQL["likes_merge"]
SQL["likes_rolled_back"] = SQL["likes_merge"].replace("AS k FROM events)", "AS k FROM events WHERE event_id < 600)")
SQL["text_search_indexed"] = """WITH t AS (SELECT doc_id AS id, replace(replace(lower(text), 'ß', 'ss'), 'ẞ', 'ss') AS folded FROM documents)
    SELECT id, q AS query FROM t, (VALUES ('SCHSS', 'schss'), ('Eß ', 'ess '), ('ẞ', 'ss')) AS v(q, f) WHERE contains(folded, f)"""
SQL["radio_source_stream"] = """WITH c AS (SELECT 's' || (conv_id % 40) AS station, conv_id, turn, conv_id || '-' || turn AS track FROM conversations),
    b AS (SELECT station, conv_id, min(track) AS last FROM c GROUP BY ALL),
    o AS (SELECT *, row_number() OVER w - 1 AS n, lag(last) OVER w AS before FROM b WINDOW w AS (PARTITION BY station ORDER BY conv_id)),
    r AS (SELECT station, n, conv_id, turn + 1 AS pos, track FROM c JOIN o USING (station, conv_id) WHERE turn % 4 <> 3 OR conv_id % 2 = 0
      UNION ALL SELECT station, n, conv_id, -1, before FROM o WHERE before IS NOT NULL),
    f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY station, track ORDER BY n, pos) = 1)
    SELECT station, row_number() OVER (PARTITION BY station ORDER BY n, pos) AS seq, CAST(conv_id AS VARCHAR) AS batch, track FROM f"""
SQL["queue_wrap_restored"] = f"WITH {QUEUE} SELECT seq_id, pos, id, row_number() OVER (PARTITION BY seq_id ORDER BY base_pos, pos) - 1 AS new_pos FROM queue"
