"""The registered queries in plain SQL, written independently: windows, range joins, dense matrices."""

from __future__ import annotations

PATTERN = r"'[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}]'"

ATTRIBUTES = r"""
  lower(word) AS lemma,
  CASE WHEN NOT regexp_matches(word, '^[\p{L}\p{N}]') THEN 'PUNCT' WHEN regexp_matches(word, '^\p{N}+$') THEN 'NUM'
       WHEN regexp_matches(word, '^\p{Lu}') THEN 'CAP' ELSE 'WORD' END AS pos_tag,
  CASE WHEN regexp_matches(word, '^[\p{L}\p{N}]') THEN lower(substr(word, 1, 3)) END AS phon,
  word AS orig,
  regexp_matches(word, '^\p{Lu}') AS is_cap,
  regexp_matches(word, '^\p{N}+$') AS is_num,
  length(word) <= 3 AS is_short
"""

DOCS = f"""
raw AS (
  SELECT doc_id AS text_id, lang, source, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS BIGINT) AS tok_no
  FROM (SELECT doc_id, lang, source, regexp_extract_all(text, {PATTERN}) AS ws FROM documents)),
sentenced AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN word IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (
    PARTITION BY text_id ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s_id FROM raw),
t AS (
  SELECT *, min(tok_no) OVER (PARTITION BY text_id, s_id) AS s_first, max(tok_no) OVER (PARTITION BY text_id, s_id) AS s_last,
  {ATTRIBUTES} FROM sentenced)
"""

TEXTS = f"""
sized AS (
  SELECT doc_id AS text_id, lang, source, n_chars, CAST(len(regexp_extract_all(text, {PATTERN})) AS BIGINT) AS n_tokens FROM documents),
texts AS (
  SELECT s.*, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic,
    CAST(sum(n_tokens) OVER (ORDER BY text_id) - n_tokens AS BIGINT) AS startpos,
    CAST(sum(n_tokens) OVER (ORDER BY text_id) - 1 AS BIGINT) AS endpos
  FROM sized s LEFT JOIN labels l ON l.doc_id = s.text_id)
"""

SHOP = """
orders_t AS (
  SELECT o_orderkey AS text_id, o_orderstatus AS status, o_orderpriority AS priority, CAST(round(o_totalprice) AS BIGINT) AS price,
    n_name AS place, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
op AS (
  SELECT DISTINCT l_orderkey AS text_id, p_partkey AS id, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey),
lines AS (
  SELECT l_orderkey AS text_id, l_returnflag AS word, l_linestatus AS pos_tag, l_returnflag || l_linestatus AS lemma FROM lineitem),
coords AS (
  SELECT n_name AS place, CAST(n_nationkey * 2 + 30 AS DOUBLE) AS lat, CAST(n_nationkey * 3 - 20 AS DOUBLE) AS lng
  FROM nation WHERE n_nationkey NOT IN (3, 7, 11)),
geo AS (
  SELECT lemma AS form, place, CAST(count(*) AS BIGINT) AS n FROM lines JOIN orders_t USING (text_id)
  WHERE place IS NOT NULL GROUP BY 1, 2)
"""

TALK = f"""
turns AS (
  SELECT conv_id AS text_id, turn AS seg_id, role, regexp_extract_all(text, {PATTERN}) AS ws FROM conversations),
seg0 AS (
  SELECT text_id, seg_id, role, CAST(len(ws) AS BIGINT) AS n,
    CAST(sum(len(ws)) OVER (ORDER BY text_id, seg_id) - len(ws) AS BIGINT) AS startpos,
    CAST(sum(len(ws)) OVER (PARTITION BY text_id ORDER BY seg_id) - len(ws) AS BIGINT) AS seg_first FROM turns),
seg AS (
  SELECT *, startpos + n - 1 AS endpos, seg_first + n - 1 AS seg_last, text_id || '_' || role AS speaker,
    CAST(seg_id * 10 AS DOUBLE) AS from_s, seg_id * 10 + CAST(9.5 AS DOUBLE) AS to_s, 'rec' || text_id AS av_file FROM seg0),
unnested AS (SELECT text_id, seg_id, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS BIGINT) AS i FROM turns),
tt AS (
  SELECT text_id, seg_id, role, speaker, seg_first, seg_last, seg_first + i AS tok_no, startpos + i AS pos, word, {ATTRIBUTES}
  FROM unnested JOIN seg USING (text_id, seg_id)),
files AS (
  SELECT DISTINCT 'rec' || conv_id AS av_file, conv_id % 2 = 0 AS has_audio, conv_id % 3 = 0 AS has_video FROM conversations)
"""

ORACLES: dict[str, str] = {}

# Self joins of the token table that the database plans badly under an outer row limit, unless they are ordered.
ORDERED = (
    "joi4_hit_metadata pat5_wildcards pat11_any_token pat12_sequence pat16_alternatives pat17_in_selection win3_match_offsets"
).split()


def oracle(name: str, sql: str, *parts: str) -> None:
    if name in ORDERED:
        sql += " ORDER BY ALL"
    ORACLES[name] = ("WITH " + ",".join(parts) + sql) if parts else sql


def per_text(hits: str, also: str = "") -> str:
    extra = f", {also}" if also else ""
    return (
        f'SELECT text_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS sum_start, CAST(sum(e) AS BIGINT) AS sum_end{extra} '
        f"FROM ({hits}) GROUP BY text_id"
    )


def where(condition: str) -> str:
    return f"SELECT text_id, tok_no AS s, tok_no AS e FROM t WHERE {condition}"


HIT = "text_id, s AS hit_start, e AS hit_end"

# two neighbouring tokens a and b of one sentence
PAIR = "t a JOIN t b ON a.text_id = b.text_id AND a.s_id = b.s_id AND b.tok_no = a.tok_no + 1"


def pair(first: str, second: str, columns: str = "a.text_id, a.tok_no AS s, b.tok_no AS e") -> str:
    return f"SELECT {columns} FROM {PAIR} WHERE {first} AND {second}"


oracle(
    "words_after_the",
    f"""SELECT b.lemma AS word, CAST(count(*) AS BIGINT) AS n FROM {PAIR} WHERE a.lemma = 'the' AND a.lang = 'en'
    GROUP BY 1 ORDER BY n DESC, word DESC LIMIT 20""",
    DOCS,
)

# ---------------------------------------------------------------- sources

oracle("src1_typed_metadata", "SELECT text_id::VARCHAR AS text_id, lang, CASE WHEN lang <> 'es' THEN source END AS origin, n_chars AS size, quality FROM texts", TEXTS)
oracle("src2_scan_attributes", "SELECT pos_tag, coalesce(phon, '') AS phon, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 2", DOCS)
oracle(
    "src2_scan_default",
    "SELECT text_id, CAST(count(DISTINCT word) AS BIGINT) AS n_words, CAST(count(DISTINCT lemma) AS BIGINT) AS n_lemmas, max(s_id) AS last_s FROM t GROUP BY 1",
    DOCS,
)
oracle("src3_corpus_size", "SELECT lang, CAST(count(*) AS BIGINT) AS n_tokens FROM t GROUP BY 1", DOCS)
oracle(
    "src4_tokenise",
    """SELECT text_id, s_id, min(tok_no) AS s_first, max(tok_no) AS s_last, CAST(count(*) AS BIGINT) AS n,
    CAST(sum((tok_no + 1) * length(word)) AS BIGINT) AS checksum FROM t GROUP BY 1, 2""",
    DOCS,
)
oracle("src4_words", "SELECT lang, word, CAST(count(*) AS BIGINT) AS n, min(tok_no) AS first_at FROM t GROUP BY 1, 2", DOCS)
for name in ("src5_text_positions", "src5_counted_positions"):
    oracle(name, "SELECT text_id, n_tokens, startpos, endpos FROM texts", TEXTS)
oracle(
    "src5_token_positions",
    """, p AS (SELECT text_id, word, row_number() OVER (ORDER BY text_id, tok_no) - 1 AS pos FROM t)
    SELECT text_id, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos,
    CAST(sum(pos * length(word)) AS BIGINT) AS checksum FROM p GROUP BY 1""",
    DOCS,
)
oracle(
    "src6_speaker_bounds",
    "SELECT speaker AS text_id, startpos AS range_start, endpos AS range_end FROM seg WHERE role <> 'system' AND n > 0",
    TALK,
)
oracle("src7_coordinates", "SELECT * FROM coords", SHOP)
oracle(
    "src8_media_manifest",
    "SELECT av_file, has_audio, has_video, false AS silent_player FROM files WHERE has_audio OR has_video",
    TALK,
)
CELL = "coalesce(max(CASE WHEN event_type = '{0}' THEN v END), '') AS {0}"
oracle(
    "src9_pivot_values",
    "SELECT user_id AS text_id, " + ", ".join(CELL.format(c) for c in ("click", "error", "purchase", "signup", "view")) + """
    FROM (SELECT user_id, event_type, CAST(value AS VARCHAR) AS v,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY 1""",
)

LATEST = """(SELECT user_id AS text_id, event_type AS category, CAST(value AS VARCHAR) AS value,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IS NOT NULL)"""
oracle("src9_value_map", f"SELECT text_id, category, coalesce(trim(value), '') AS value FROM {LATEST} WHERE k = 1")
oracle(
    "src9_map_columns",
    f"""SELECT text_id, coalesce(max(CASE WHEN category = 'purchase' THEN value END), '') AS purchase,
    coalesce(max(CASE WHEN category = 'view' THEN value END), '') AS view, '' AS "never seen" FROM {LATEST} WHERE k = 1 GROUP BY 1""",
)

# ---------------------------------------------------------------- text selection

ID_TOKENS = "SELECT text_id, n_tokens FROM texts WHERE "
oracle("flt1_include", ID_TOKENS + "source IN ('src1', 'src2', 'src7')", TEXTS)
oracle("flt2_exclude_keeps_missing", ID_TOKENS + "quality IS NULL OR quality <> 0", TEXTS)
oracle("flt3_interval", ID_TOKENS + "n_chars BETWEEN 500 AND 3000", TEXTS)
oracle(
    "flt3_open_interval",
    """SELECT text_id, n_tokens, 'low' AS side FROM texts WHERE n_chars >= 5000
    UNION ALL SELECT text_id, n_tokens, 'high' FROM texts WHERE n_chars <= 400""",
    TEXTS,
)
oracle("flt4_combined", ID_TOKENS + "lang IN ('en', 'de') AND (toxic IS NULL OR toxic <> 1) AND n_chars >= 200", TEXTS)
oracle("flt5_facet_values", "SELECT DISTINCT lang AS value FROM texts WHERE source IN ('src1', 'src2')", TEXTS)
oracle("flt6_language", "SELECT text_id, lang, n_tokens FROM texts WHERE lang = 'de'", TEXTS)
oracle(
    "flt7_tokens_of_texts",
    """SELECT text_id, CAST(count(*) AS BIGINT) AS n FROM t WHERE source IN ('src3', 'src4')
    AND text_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1""",
    DOCS,
)
oracle(
    "flt7_texts_in_span",
    """SELECT text_id, startpos, endpos FROM texts, (SELECT max(endpos) AS m FROM texts)
    WHERE startpos >= m // 4 AND endpos <= m // 2""",
    TEXTS,
)
oracle(
    "flt8_speaker_ranges",
    "SELECT speaker, CAST(count(*) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM tt WHERE role = 'assistant' GROUP BY 1",
    TALK,
)
oracle(
    "flt8_all_listed",
    "SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM tt WHERE role <> 'system' GROUP BY 1",
    TALK,
)
oracle("flt9_present_values", "SELECT text_id, quality FROM texts WHERE quality IS NOT NULL", TEXTS)

POLYGONS = """(lat >= 31 AND lat < 51 AND lng >= -19 AND lng < 12)
 OR (CASE WHEN (50 > lat) <> (80 > lat) AND lng < (20 - 0) * (lat - 50) / (80.0 - 50) + 0 THEN 1 ELSE 0 END
   + CASE WHEN (80 > lat) <> (60 > lat) AND lng < (60 - 20) * (lat - 80) / (60.0 - 80) + 20 THEN 1 ELSE 0 END
   + CASE WHEN (60 > lat) <> (50 > lat) AND lng < (0 - 60) * (lat - 60) / (50.0 - 60) + 60 THEN 1 ELSE 0 END) % 2 = 1"""
oracle("flt11_in_polygons", f"SELECT * FROM coords WHERE {POLYGONS}", SHOP)
oracle(
    "flt11_polygon_table",
    """WITH places AS (
      SELECT CAST(s_suppkey AS VARCHAR) AS place, CAST(s_suppkey * 37 % 1700 AS DOUBLE) / 10.0::DOUBLE - 85 AS lat,
        CAST(s_suppkey * 73 % 3600 AS DOUBLE) / 10.0::DOUBLE - 180 AS lng FROM supplier),
    around(corner, up, aside) AS (VALUES (0, 1.0, 0.0), (1, 0.5, 1.0), (2, -0.5, 1.0), (3, -1.0, 0.0), (4, -0.5, -1.0), (5, 0.5, -1.0)),
    corners AS (
      SELECT n_nationkey AS polygon, corner, n_nationkey * 6 - 70 + up::DOUBLE * (5 + n_regionkey) AS lat,
        n_nationkey * 15 - 180 + aside::DOUBLE * (8 + n_regionkey) AS lng FROM nation, around),
    globe AS (
      SELECT polygon, corner, lat, CASE WHEN lng < -180 THEN lng + 360 WHEN lng >= 180 THEN lng - 360 ELSE lng END AS lng FROM corners),
    jumps AS (SELECT polygon, max(lng) - min(lng) > 180 AS wraps FROM globe GROUP BY 1),
    flat AS (SELECT polygon, corner, wraps, lat, CASE WHEN wraps AND lng < 0 THEN lng + 360 ELSE lng END AS lng FROM globe JOIN jumps USING (polygon)),
    edges AS (
      SELECT a.polygon, a.wraps, a.lat AS a_lat, a.lng AS a_lng, b.lat AS b_lat, b.lng AS b_lng
      FROM flat a JOIN flat b ON b.polygon = a.polygon AND b.corner = (a.corner + 1) % 6),
    crossed AS (
      SELECT place, polygon FROM places, edges WHERE (a_lat > lat) <> (b_lat > lat)
        AND CASE WHEN wraps AND lng < 0 THEN lng + 360 ELSE lng END < (b_lng - a_lng) * (lat - a_lat) / (b_lat - a_lat) + a_lng),
    inside AS (SELECT DISTINCT place FROM (SELECT place, polygon FROM crossed GROUP BY 1, 2 HAVING count(*) % 2 = 1))
    SELECT place, round(lat, 6) AS lat, round(lng, 6) AS lng FROM places JOIN inside USING (place)""",
)
oracle("flt11_no_polygon", "SELECT * FROM coords", SHOP)
oracle(
    "flt12_facets",
    """SELECT text_id, lang, n_chars FROM texts WHERE lang IN ('en', 'fr') AND (quality = 1 OR quality IS NULL)
    AND n_chars BETWEEN 300 AND 6000""",
    TEXTS,
)
oracle("flt12_empty_facet", "SELECT text_id FROM texts WHERE false", TEXTS)
oracle("flt12_extent", "SELECT min(quality) AS low, max(quality) AS high, bool_or(quality IS NULL) AS nulls FROM texts", TEXTS)

# ---------------------------------------------------------------- joins

WANTED = "brand IN ('Brand#2', 'Brand#7') AND size BETWEEN 10 AND 20"
oracle("joi1_dimension_rows", f"SELECT text_id, brand, type, size FROM op WHERE {WANTED}", SHOP)
oracle(
    "joi2_many_to_many_include",
    f"SELECT text_id, status, n_tokens FROM orders_t WHERE text_id IN (SELECT text_id FROM op WHERE {WANTED})",
    SHOP,
)
oracle(
    "joi3_many_to_many_exclude",
    """SELECT text_id, status, n_tokens FROM orders_t WHERE status IN ('O', 'F')
    AND text_id NOT IN (SELECT text_id FROM op WHERE brand IN ('Brand#2', 'Brand#7'))""",
    SHOP,
)
oracle(
    "joi4_hit_metadata",
    f"""SELECT a.text_id || '.' || a.s_id AS segment, a.tok_no AS hit_start, a.source, coalesce(CAST(quality AS VARCHAR), '') AS quality
    FROM {PAIR} LEFT JOIN labels ON doc_id = a.text_id WHERE a.lemma = 'the' AND b.lemma = 'of'""",
    DOCS,
)
oracle(
    "joi4_hit_lists",
    """SELECT text_id, n, coalesce(brand, '') AS brand
    FROM (SELECT text_id, CAST(count(*) AS BIGINT) AS n FROM lines WHERE lemma = 'RF' GROUP BY 1)
    LEFT JOIN (SELECT text_id, string_agg(brand, '; ' ORDER BY brand) AS brand FROM op GROUP BY 1) USING (text_id)""",
    SHOP,
)
oracle("joi5_token_in_range", "SELECT text_id, CAST(count(*) AS BIGINT) AS n FROM t WHERE lang = 'es' GROUP BY 1", DOCS)
COMMON = "IN ('the', 'der', 'la', 'de')"
oracle(
    "joi6_aligned_search",
    f"""SELECT text_id, tok_no AS hit_start, tok_no AS hit_end FROM tt u WHERE role = 'user' AND lemma {COMMON} AND EXISTS (
      SELECT 1 FROM tt a JOIN tt b ON a.text_id = b.text_id AND a.seg_id = b.seg_id AND b.tok_no = a.tok_no + 1
      WHERE a.text_id = u.text_id AND a.seg_id = u.seg_id + 1 AND a.role = 'assistant' AND a.lemma {COMMON} AND suffix(b.lemma, 'n'))""",
    TALK,
)
oracle(
    "joi7_aligned_text",
    """SELECT u.text_id, u.tok_no AS hit_start, u.tok_no AS hit_end, 'assistant' AS tgt_lang, string_agg(a.word, ' ' ORDER BY a.tok_no) AS aligned
    FROM tt u JOIN tt a ON a.text_id = u.text_id AND a.seg_id = u.seg_id + 1 AND a.role = 'assistant'
    WHERE u.role = 'user' AND u.tok_no = u.seg_first AND starts_with(u.lemma, 'the') GROUP BY 1, 2, 3""",
    TALK,
)
oracle(
    "joi8_hit_places",
    "SELECT word AS form, place, CAST(count(*) AS BIGINT) AS n FROM lines JOIN orders_t USING (text_id) WHERE place IS NOT NULL GROUP BY 1, 2",
    SHOP,
)
oracle("joi9_placed", "SELECT place, form, n, lat, lng FROM geo JOIN coords USING (place)", SHOP)
oracle("joi9_unknown_places", "SELECT DISTINCT place FROM geo WHERE place NOT IN (SELECT place FROM coords)", SHOP)
oracle(
    "joi10_media_flags",
    """SELECT tt.text_id, tok_no AS hit_start, f.av_file, CASE WHEN has_audio THEN 'sound' ELSE 'none' END AS audio, has_video
    FROM tt JOIN files f ON f.av_file = 'rec' || tt.text_id WHERE lemma = 'the'""",
    TALK,
)
oracle(
    "joi10_silent_player",
    """SELECT 'nosound' AS audio, coalesce(has_video, false) AS has_video, CAST(count(*) AS BIGINT) AS n
    FROM tt LEFT JOIN files f ON f.av_file = 'rec' || tt.text_id WHERE lemma = 'the' GROUP BY 1, 2""",
    TALK,
)
TREE = "tree AS (SELECT text_id, s_id, word, pos_tag AS dep_fun, tok_no - s_first + 1 AS i, (tok_no - s_first + 1) // 2 AS h FROM t)"
oracle(
    "joi11_dependency_edges",
    """SELECT c.text_id, c.dep_fun, CAST(count(*) AS BIGINT) AS n, CAST(sum(abs(c.i - c.h)) AS BIGINT) AS sum_distance,
    CAST(sum(length(p.word)) AS BIGINT) AS head_chars
    FROM tree c JOIN tree p ON c.text_id = p.text_id AND c.s_id = p.s_id AND c.h = p.i GROUP BY 1, 2""",
    DOCS,
    TREE,
)
oracle(
    "joi11_child_sides",
    """SELECT text_id, sides, CAST(count(*) AS BIGINT) AS n, CAST(sum(h) AS BIGINT) AS sum_head FROM (
      SELECT text_id, s_id, h, CASE WHEN min(i) < h AND max(i) > h THEN 'LR' WHEN min(i) < h THEN 'L' ELSE 'R' END AS sides
      FROM tree WHERE h <> 0 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    DOCS,
    TREE,
)

# ---------------------------------------------------------------- patterns

oracle(
    "pat1_equals",
    per_text(where("lemma = 'the'"), "'word' AS kind") + " UNION ALL " + per_text(where("phon = 'the'"), "'phon' AS kind"),
    DOCS,
)
COUNT = "SELECT CAST(count(*) AS BIGINT) AS n_hits, '{0}' AS attribute FROM t WHERE {1}"
oracle(
    "pat2_attribute_choice",
    " UNION ALL ".join(
        COUNT.format(n, c)
        for n, c in (("lemma", "lemma = 'of'"), ("phon", "phon = 'and'"), ("orig", "lower(orig) = 'in'"), ("word", "lower(word) = 'to'"))
    ),
    DOCS,
)
oracle(
    "pat3_affixes",
    " UNION ALL ".join(
        per_text(where(c), f"'{n}' AS place")
        for n, c in (("start", "starts_with(lemma, 'th')"), ("end", "suffix(lemma, 'ing')"), ("middle", "contains(lemma, 'oré')"))
    ),
    DOCS,
)
oracle("pat4_literal_characters", per_text(where("word IN ('|', '*') OR starts_with(word, '$')")), DOCS)
oracle("pat5_wildcards", pair("a.lemma LIKE 'th%n'", "b.lemma = 'of'", "a.text_id, a.tok_no AS hit_start, b.tok_no AS hit_end"), DOCS)
oracle("pat5_blank", per_text("SELECT text_id, tok_no AS s, tok_no AS e FROM t"), DOCS)
oracle("pat11_everything", per_text("SELECT text_id, tok_no AS s, tok_no + 1 AS e FROM t WHERE tok_no < s_last"), DOCS)
oracle("pat5_literal_wildcards", per_text(pair("a.word = '%'", "true")), DOCS)
oracle("pat6_regex", per_text(where("regexp_full_match(word, 'Th.*|of|in|[0-9]+')")), DOCS)
oracle("pat6_vocabulary", per_text(where("regexp_full_match(word, 'Th.*|of|in|[0-9]+')")), DOCS)
oracle("pat6_alternatives", per_text(where("word IN ('de', 'la', 'der')")), DOCS)
oracle("pat7_extra_forms", per_text(where("starts_with(lemma, 'th') AND pos_tag IN ('CAP', 'NUM') AND lemma NOT IN ('the', 'that')")), DOCS)
oracle("pat8_category", per_text(where("pos_tag = 'CAP' AND phon IN ('the', 'tha') AND lemma <> 'the'")), DOCS)
oracle("pat9_sections", per_text(where("((pos_tag = 'CAP' AND phon = 'the') OR pos_tag = 'NUM') AND lemma <> 'the' AND lemma <> 'then'")), DOCS)
oracle("pat10_sets", per_text(where("is_cap AND NOT is_short")), DOCS)
oracle(
    "pat11_any_token",
    """SELECT a.text_id, a.tok_no - 1 AS hit_start, b.tok_no + 1 AS hit_end FROM t a
    JOIN t b ON a.text_id = b.text_id AND a.s_id = b.s_id AND b.tok_no = a.tok_no + 2
    WHERE a.lemma = 'the' AND b.lemma = 'of' AND a.tok_no - 1 >= a.s_first AND b.tok_no + 1 <= b.s_last""",
    DOCS,
)
oracle("pat12_sequence", pair("a.lemma = 'of'", "b.lemma = 'the'", "a.text_id, a.tok_no AS hit_start, b.tok_no AS hit_end"), DOCS)
oracle(
    "pat12_three_terms",
    """SELECT text_id, tok_no AS hit_start, tok_no + 2 AS hit_end FROM (
      SELECT *, lead(lemma, 1) OVER w AS l1, lead(lemma, 2) OVER w AS l2 FROM t WINDOW w AS (PARTITION BY text_id, s_id ORDER BY tok_no))
    WHERE starts_with(lemma, 't') AND l1 = 'the' AND suffix(l2, 'e')""",
    DOCS,
)
SAME = "{1}.text_id = {0}.text_id AND {1}.s_id = {0}.s_id"
oracle(
    "pat3_vocabulary",
    per_text(
        f"""SELECT a.text_id, a.tok_no AS s, min(b.tok_no) AS e FROM t a
        JOIN t b ON {SAME.format("a", "b")} AND b.tok_no BETWEEN a.tok_no + 1 AND a.tok_no + 3 AND contains(b.lemma, 'er')
        WHERE suffix(a.lemma, 'ing') GROUP BY 1, 2"""
    ),
    DOCS,
)
GAPPED = f"""SELECT a.text_id, a.tok_no AS hit_start, min(c.tok_no) AS hit_end FROM t a
    JOIN t b ON {SAME.format("a", "b")} AND b.tok_no BETWEEN a.tok_no + 1 AND a.tok_no + 3 AND b.lemma = 'of'
    JOIN t c ON {SAME.format("b", "c")} AND c.tok_no BETWEEN b.tok_no + 2 AND b.tok_no + 4 AND c.lemma = 'and'
    WHERE a.lemma = 'the' GROUP BY 1, 2"""
oracle("pat13_gaps", GAPPED, DOCS)
oracle(
    "pat13_long_gap",
    f"""SELECT a.text_id, a.tok_no AS hit_start, min(c.tok_no) AS hit_end FROM t a
    JOIN t b ON {SAME.format("a", "b")} AND b.tok_no BETWEEN a.tok_no + 6 AND a.tok_no + 41 AND b.lemma = 'of'
    JOIN t c ON {SAME.format("b", "c")} AND c.tok_no = b.tok_no + 1 AND c.lemma = 'the'
    WHERE a.lemma = 'in' GROUP BY 1, 2""",
    DOCS,
)
oracle(
    "pat13_open_gap",
    f"""SELECT a.text_id, a.tok_no AS hit_start, min(c.tok_no) AS hit_end FROM t a
    JOIN t b ON {SAME.format("a", "b")} AND b.tok_no >= a.tok_no + 3 AND b.lemma = 'of'
    JOIN t c ON {SAME.format("b", "c")} AND c.tok_no BETWEEN b.tok_no + 1 AND b.tok_no + 4 AND c.lemma = 'the'
    WHERE a.lemma = 'that' GROUP BY 1, 2""",
    DOCS,
)
oracle(
    "pat13_leading_gap",
    per_text(
        f"""SELECT a.text_id, a.tok_no AS s, min(b.tok_no) AS e FROM t a
        JOIN t b ON {SAME.format("a", "b")} AND b.tok_no BETWEEN a.tok_no + 1 AND a.tok_no + 3 AND b.lemma = 'with' GROUP BY 1, 2"""
    ),
    DOCS,
)
oracle(
    "pat14_edges",
    per_text("SELECT text_id, tok_no AS s, tok_no + 1 AS e FROM t WHERE lemma = 'the' AND tok_no = s_first AND tok_no < s_last", "'first' AS edge")
    + " UNION ALL "
    + per_text(pair("a.lemma = 'the'", "b.word = '.' AND b.tok_no = b.s_last"), "'last' AS edge")
    + " UNION ALL "
    + per_text(where("word = '.' AND tok_no = s_first"), "'both' AS edge"),
    DOCS,
)
oracle(
    "pat15_within_segment",
    """SELECT a.text_id, a.tok_no AS hit_start, min(b.tok_no) AS hit_end FROM tt a
    JOIN tt b ON a.text_id = b.text_id AND a.seg_id = b.seg_id AND b.tok_no BETWEEN a.tok_no + 1 AND a.tok_no + 4 AND b.word = '.'
    WHERE a.word = '.' GROUP BY 1, 2""",
    TALK,
)
oracle(
    "pat16_alternatives",
    pair("a.lemma IN ('of', 'to')", "(b.lemma = 'the' OR (a.lemma = 'of' AND starts_with(b.lemma, 'th')))", "a.text_id, a.tok_no AS hit_start, b.tok_no AS hit_end"),
    DOCS,
)
oracle(
    "pat17_in_selection",
    """SELECT text_id, tok_no AS hit_start, tok_no AS hit_end FROM t WHERE lemma = 'the'
    AND lang = 'en' AND text_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
    AND text_id IN (SELECT doc_id FROM documents WHERE n_chars >= 300)""",
    DOCS,
)
ORACLES["pat17_stored_selection"] = ORACLES["pat17_in_selection"]
oracle(
    "pat17_in_speakers",
    """SELECT a.text_id, a.tok_no AS hit_start, b.tok_no AS hit_end FROM tt a
    JOIN tt b ON a.text_id = b.text_id AND a.seg_id = b.seg_id AND b.tok_no = a.tok_no + 1
    WHERE a.role = 'user' AND suffix(a.lemma, 'e') AND starts_with(b.lemma, 'e')""",
    TALK,
)
oracle(
    "pat18_count",
    f"""SELECT CAST(count(DISTINCT (a.text_id, a.tok_no)) AS BIGINT) AS n_hits FROM t a
    JOIN t b ON {SAME.format("a", "b")} AND b.tok_no BETWEEN a.tok_no + 1 AND a.tok_no + 2
    WHERE starts_with(a.lemma, 't') AND b.lemma = 'the'""",
    DOCS,
)

# ---------------------------------------------------------------- concordance


def kwic(hits: str, n: int, value: str = "word") -> str:
    """Hits (text_id, s, e) in context of n tokens."""
    part = "coalesce(string_agg({v}, ' ' ORDER BY tok_no) FILTER (WHERE {c}), '') AS {n}_text"
    columns = ", ".join(
        part.format(v=value, c=c, n=name) for name, c in (("left", "tok_no < s"), ("match", "tok_no BETWEEN s AND e"), ("right", "tok_no > e"))
    )
    return f""", h AS ({hits}), k AS (SELECT text_id, s, e, {columns}
    FROM h JOIN t USING (text_id) WHERE tok_no BETWEEN s - {n} AND e + {n} GROUP BY text_id, s, e)"""


OF_THE = pair("a.lemma = 'of'", "b.lemma = 'the'")
FROM_THE = pair("a.lemma = 'from'", "b.lemma = 'the'")
LINE = "left_text, match_text, right_text"
oracle("kwi1_context", kwic(OF_THE, 15) + f"SELECT {HIT}, {LINE} FROM k", DOCS)
oracle(
    "kwi1_stored_context",
    kwic(
        f"""SELECT a.text_id, a.tok_no AS s, min(b.tok_no) AS e FROM t a
        JOIN t b ON {SAME.format("a", "b")} AND b.tok_no > a.tok_no AND b.lemma = 'that' WHERE a.lemma = 'from' GROUP BY 1, 2""",
        50,
    )
    + f"SELECT {HIT}, {LINE} FROM k",
    DOCS,
)
oracle("kwi1_by_position", kwic(FROM_THE, 15) + f"SELECT {HIT}, {LINE} FROM k", DOCS)
oracle("kwi1_treebank", kwic(FROM_THE, 25) + f"SELECT {HIT}, {LINE} FROM k", DOCS)
oracle("kwi2_text_edges", kwic(
    """SELECT text_id, tok_no AS s, tok_no AS e FROM (SELECT *, max(tok_no) OVER (PARTITION BY text_id) AS last FROM t)
    WHERE starts_with(lemma, 'th') AND (tok_no = 0 OR tok_no >= last - 2)""", 50) + f"SELECT {HIT}, {LINE} FROM k", DOCS)
oracle(
    "kwi3_segment_context",
    """SELECT h.text_id, h.tok_no AS hit_start, seg.seg_id, seg.speaker, from_s, to_s, seg.seg_id = h.seg_id AS is_match
    FROM tt h JOIN seg ON seg.text_id = h.text_id AND abs(seg.seg_id - h.seg_id) <= 1
    WHERE h.tok_no = h.seg_first AND starts_with(h.lemma, 'th')""",
    TALK,
)
oracle(
    "kwi4_attributes",
    kwic(
        f"""SELECT a.text_id, a.tok_no AS s, min(b.tok_no) AS e FROM t a
        JOIN t b ON {SAME.format("a", "b")} AND b.tok_no BETWEEN a.tok_no + 1 AND a.tok_no + 3 AND b.lemma = 'that'
        WHERE a.lemma = 'of' GROUP BY 1, 2""",
        3,
        "word || '/' || lemma || '/' || coalesce(phon, '') || '/' || pos_tag",
    )
    + f"SELECT {HIT}, {LINE} FROM k",
    DOCS,
)
oracle(
    "kwi5_multiword",
    r"SELECT replace(regexp_replace(p_name || ' 1 / 2', '(\d+) / (\d+)', '\1/\2', 'g'), ' ', '_') AS token, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1",
)
oracle(
    "kwi6_fields",
    kwic(FROM_THE, 5)
    + f"""SELECT startpos + s AS pos, text_id || '.' || s_id AS segment, {LINE}
    FROM k JOIN texts USING (text_id) JOIN (SELECT text_id, tok_no AS s, s_id FROM t) USING (text_id, s)""",
    DOCS,
    TEXTS,
)
oracle(
    "kwi7_hidden_values",
    """SELECT lang, concat_ws(' ', CASE WHEN word NOT IN ('-', '_') THEN word END,
      CASE WHEN lemma NOT IN ('-', '_') THEN '"' || lemma || '"' END, CASE WHEN phon NOT IN ('-', '_') THEN phon END) AS tip,
    CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 2""",
    DOCS,
)
oracle("kwi8_markup", "SELECT page_id, md5(replace(replace(html, ' ', '&nbsp;'), '&nbsp;', '_')) AS cleaned FROM pages")
oracle(
    "kwi9_original_rows",
    kwic(pair("a.lemma = 'by'", "b.lemma = 'the'"), 4)
    + """SELECT text_id, s AS hit_start, 1 AS line, left_text, match_text, right_text FROM k UNION ALL
    SELECT text_id, s, 2, upper(left_text), upper(match_text), upper(right_text) FROM k""",
    DOCS,
)
oracle(
    "kwi10_media_object",
    """, lines AS (SELECT seg.*, array_to_string(ws, ' ') AS line FROM seg JOIN turns USING (text_id, seg_id))
    SELECT h.text_id, h.tok_no AS hit_start, min(l.from_s) AS start_s, max(l.to_s) AS stop_s,
      CAST(count(*) FILTER (WHERE l.seg_id < h.seg_id) AS INTEGER) AS match_at, CAST(count(*) - 1 AS INTEGER) AS last_line,
      string_agg(l.speaker || '|' || l.from_s || '|' || line, chr(10) ORDER BY l.seg_id) AS lines
    FROM tt h JOIN lines l ON l.text_id = h.text_id AND abs(l.seg_id - h.seg_id) <= 1
    WHERE h.tok_no = h.seg_first AND h.lemma = 'the' GROUP BY h.text_id, h.tok_no""",
    TALK,
)
oracle(
    "kwi10_whole_episode",
    """, one AS (SELECT text_id, seg_id AS hit_seg FROM tt WHERE lemma = 'the' ORDER BY text_id, tok_no LIMIT 1 OFFSET 59)
    SELECT text_id, seg_id, seg_id AS line_no, speaker, seg_id = hit_seg AS is_match FROM seg JOIN one USING (text_id)""",
    TALK,
)
oracle(
    "kwi11_links",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 OR url NOT LIKE 'http%' THEN 'none' ELSE url || ' ' || url || '?b' END AS links FROM pages",
)

# ---------------------------------------------------------------- order, pages, samples

KEYED = """, w AS (SELECT *, lead(lemma) OVER s AS next_lemma, lag(lemma) OVER d AS by_left, lead(lemma, 2) OVER d AS by_right FROM t
      WINDOW s AS (PARTITION BY text_id, s_id ORDER BY tok_no), d AS (PARTITION BY text_id ORDER BY tok_no)),
  keyed AS (SELECT text_id, tok_no AS s, lemma || ' ' || next_lemma AS by_match, by_left, by_right FROM w
    WHERE lemma = 'of' AND starts_with(next_lemma, 't'))"""
oracle("srt1_by_position", KEYED + "SELECT text_id, s AS hit_start, '-' AS sort_key FROM keyed ORDER BY text_id, s LIMIT 50 OFFSET 50", DOCS)
for number, key in ((2, "match"), (3, "left"), (4, "right")):
    oracle(
        f"srt{number}_by_{key}",
        KEYED
        + f"""SELECT text_id, s AS hit_start, coalesce(by_{key}, '-') AS sort_key FROM keyed
        ORDER BY by_{key} NULLS LAST, text_id, s LIMIT 50 OFFSET 50""",
        DOCS,
    )
ORACLES["srt4_without_neighbours"] = ORACLES["srt4_by_right"]
oracle(
    "srt5_edge_hits_last",
    """, h AS (SELECT u.text_id, u.tok_no, p.lemma AS k FROM tt u
      LEFT JOIN tt p ON p.text_id = u.text_id AND p.seg_id = u.seg_id AND p.tok_no = u.tok_no - 1 WHERE u.lemma = 'the')
    SELECT text_id, tok_no AS hit_start, coalesce(k, '-') AS sort_key
    FROM (SELECT *, row_number() OVER (ORDER BY k NULLS LAST, text_id, tok_no) - 1 AS n, count(*) OVER () AS c FROM h)
    WHERE n // 50 = (c - 1) // 50""",
    TALK,
)
oracle(
    "srt6_by_frequency",
    "SELECT lemma AS word, CAST(count(*) AS BIGINT) AS n FROM t WHERE starts_with(lemma, 'th') GROUP BY 1 ORDER BY n DESC, word DESC LIMIT 40",
    DOCS,
)
oracle(
    "srt7_metadata_order",
    """SELECT * FROM (SELECT 'price' AS sorted, text_id, price FROM orders_t ORDER BY price NULLS FIRST, text_id LIMIT 50 OFFSET 100)
    UNION ALL SELECT * FROM (SELECT 'brand' AS sorted, text_id, price FROM orders_t
      LEFT JOIN (SELECT text_id, min(brand) AS b FROM op GROUP BY 1) USING (text_id) ORDER BY b DESC NULLS LAST, text_id LIMIT 50 OFFSET 50)""",
    SHOP,
)
oracle(
    "lim1_first_pages",
    f""", h AS ({OF_THE}) SELECT (n - 1) // 50 + 1 AS page, text_id, s AS hit_start
    FROM (SELECT *, row_number() OVER (ORDER BY text_id, s) AS n FROM h) WHERE n <= 100""",
    DOCS,
)
oracle("lim1_page_count", "SELECT CAST(count(*) AS BIGINT) AS n_hits, CAST(ceil(count(*) / 50.0) AS BIGINT) AS n_pages FROM t WHERE lemma = 'of'", DOCS)
oracle(
    "lim1_deep_slice",
    """SELECT * FROM (SELECT row_number() OVER (ORDER BY text_id, tok_no) - 1 AS hit_no, text_id, tok_no AS hit_start FROM t WHERE lemma = 'the')
    WHERE hit_no BETWEEN 12000 AND 12049""",
    DOCS,
)
oracle(
    "lim1_deep_page",
    """, w AS (SELECT text_id, tok_no, lemma, lead(lemma) OVER (PARTITION BY text_id ORDER BY tok_no) AS k FROM t)
    SELECT text_id, tok_no AS hit_start, coalesce(k, '-') AS sort_key FROM w WHERE starts_with(lemma, 't')
    ORDER BY k NULLS LAST, text_id, tok_no LIMIT 50 OFFSET 6950""",
    DOCS,
)
oracle("lim2_metadata_page", "SELECT text_id, source FROM texts ORDER BY text_id LIMIT 50 OFFSET 150", TEXTS)
oracle(
    "lim3_export_cap",
    """, h AS (SELECT text_id, tok_no AS hit_start, tok_no AS hit_end FROM t WHERE lemma = 'of')
    SELECT *, 'none' AS cap FROM h UNION ALL SELECT * FROM (SELECT *, '500' AS cap FROM h ORDER BY text_id, hit_start LIMIT 500)""",
    DOCS,
)
oracle(
    "lim4_one_text",
    """SELECT text_id, lang, source, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic
    FROM texts WHERE text_id = 4""",
    TEXTS,
)
DRAW = "md5(concat_ws(':', '{0}', text_id, tok_no, tok_no))"
for name, size, seed in (("smp1_random_hits", 1000, 42), ("smp1_large_sample", 9000, 7)):
    oracle(
        name,
        f"SELECT text_id, tok_no AS hit_start, tok_no AS hit_end FROM t WHERE lemma = 'the' ORDER BY {DRAW.format(seed)}, text_id, tok_no LIMIT {size}",
        DOCS,
    )
oracle(
    "smp2_random_by_part",
    f""", q AS (SELECT lang, ceil(501 * count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM t)) AS quota FROM t GROUP BY 1)
    SELECT part, text_id, hit_start FROM (
      SELECT lang AS part, text_id, tok_no AS hit_start, quota, {DRAW.format(3)} AS d,
        row_number() OVER (PARTITION BY lang ORDER BY {DRAW.format(3)}, text_id, tok_no) AS k
      FROM t JOIN q USING (lang) WHERE lemma IN ('the', 'de', 'der', 'la')) WHERE k <= quota ORDER BY d, text_id, hit_start LIMIT 501""",
    DOCS,
)

# ---------------------------------------------------------------- counts and lists

oracle(
    "agg1_text_count",
    """SELECT 'some' AS which, CAST(count(*) AS BIGINT) AS n_texts, CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS n_tokens FROM orders_t
    WHERE status = 'O' AND text_id NOT IN (SELECT text_id FROM op WHERE brand = 'Brand#3') UNION ALL SELECT 'none', 0, 0""",
    SHOP,
)
oracle(
    "agg2_speaker_count",
    """SELECT 'all' AS which, CAST(count(DISTINCT speaker) AS BIGINT) AS n_texts, CAST(sum(n) AS BIGINT) AS n_tokens FROM seg WHERE role <> 'system'
    UNION ALL SELECT 'user', count(DISTINCT speaker), CAST(sum(n) AS BIGINT) FROM seg WHERE role = 'user'""",
    TALK,
)
oracle(
    "agg3_category_range",
    """SELECT min(price) AS min_value, max(price) AS max_value FROM orders_t
    WHERE status = 'O' AND text_id IN (SELECT text_id FROM op WHERE brand = 'Brand#2')""",
    SHOP,
)
oracle(
    "agg4_distinct_values",
    "SELECT DISTINCT type AS value FROM op JOIN orders_t USING (text_id) WHERE brand = 'Brand#2' AND status = 'O'",
    SHOP,
)
LISTED = "(SELECT text_id, string_agg(brand, '; ' ORDER BY brand) AS brand FROM op GROUP BY 1)"
oracle("agg5_listed_values", f"SELECT * FROM {LISTED}", SHOP)
oracle(
    "agg6_metadata_table",
    f"""SELECT text_id, status, CAST(price AS VARCHAR) AS price, coalesce(brand, '') AS brand FROM orders_t o LEFT JOIN {LISTED} USING (text_id)
    WHERE status = 'P' AND text_id NOT IN (SELECT text_id FROM op WHERE type = 'SMALL') ORDER BY o.price DESC NULLS LAST, text_id LIMIT 50 OFFSET 50""",
    SHOP,
)
ORACLES["agg6_metadata_page"] = ORACLES["agg6_metadata_table"]
oracle(
    "agg7_frequency_list",
    f""", h AS (SELECT a.text_id, a.tok_no AS s, min(b.tok_no) AS e FROM t a
      JOIN t b ON {SAME.format("a", "b")} AND b.tok_no BETWEEN a.tok_no + 1 AND a.tok_no + 2 AND starts_with(b.lemma, 't')
      WHERE a.lemma = 'of' GROUP BY 1, 2),
    m AS (SELECT text_id, s, lower(string_agg(word, ' ' ORDER BY tok_no)) AS word, lower(string_agg(pos_tag, ' ' ORDER BY tok_no)) AS pos_tag
      FROM h JOIN t USING (text_id) WHERE tok_no BETWEEN s AND e GROUP BY 1, 2)
    SELECT word, pos_tag, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1, 2""",
    DOCS,
)
oracle(
    "agg7_sequence_list",
    pair("a.lemma = 'of'", "starts_with(b.lemma, 't')", "a.lemma || ' ' || b.lemma AS word, CAST(count(*) AS BIGINT) AS n") + " GROUP BY 1",
    DOCS,
)
oracle(
    "agg7_one_token_list",
    "SELECT lemma, coalesce(phon, '') AS phon, CAST(count(*) AS BIGINT) AS n FROM t WHERE is_cap GROUP BY 1, 2",
    DOCS,
)
oracle("agg7_default_attribute", "SELECT lemma AS word, CAST(count(*) AS BIGINT) AS n FROM t WHERE starts_with(lemma, 'th') GROUP BY 1", DOCS)
oracle("agg8_case_sensitive", "SELECT word, CAST(count(*) AS BIGINT) AS n FROM t WHERE starts_with(lemma, 'th') GROUP BY 1", DOCS)
oracle(
    "agg9_match_part",
    f""", h AS ({GAPPED}), m AS (
      SELECT h.text_id, hit_start, lower(coalesce(string_agg(word, ' ' ORDER BY tok_no) FILTER (WHERE tok_no <= hit_start + 2), '')) AS w1,
        lower(string_agg(word, ' ' ORDER BY tok_no) FILTER (WHERE tok_no >= hit_start + 2)) AS w2
      FROM h JOIN t ON t.text_id = h.text_id AND tok_no BETWEEN hit_start + 1 AND hit_end GROUP BY 1, 2)
    SELECT w1 AS word, CAST(count(*) AS BIGINT) AS n, '2-3' AS part FROM m GROUP BY 1
    UNION ALL SELECT w2, CAST(count(*) AS BIGINT), '3-' FROM m GROUP BY 1""",
    DOCS,
)
COMMON_WORDS = "lemma IN ('the', 'of', 'de', 'la', 'der', 'un', 'is')"


def distribution(condition: str, category: str) -> str:
    """Dense matrix of all attribute values by all category values."""
    return f""", bt AS (SELECT lemma AS attr, text_id, count(*) AS n FROM t WHERE {condition} GROUP BY 1, 2),
    vt AS (SELECT text_id, {category} AS value, n_tokens FROM texts WHERE {category} IS NOT NULL),
    totals AS (SELECT value, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS n_texts FROM vt GROUP BY 1),
    cells AS (SELECT attr, value, CAST(sum(n) AS BIGINT) AS n FROM bt JOIN vt USING (text_id) GROUP BY 1, 2),
    dense AS (SELECT attr, value, CAST(coalesce(n, 0) AS BIGINT) AS n, totals.n_tokens / (SELECT CAST(sum(n_tokens) AS DOUBLE) FROM totals) AS expected
      FROM (SELECT DISTINCT attr FROM bt) CROSS JOIN totals LEFT JOIN cells USING (attr, value)),
    scores AS (SELECT attr, CAST(sum(n) AS BIGINT) AS total, round(sum(abs(expected - n / nullif(w, 0))) / 2, 9) AS dp
      FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY attr) AS DOUBLE) AS w FROM dense) GROUP BY 1),
    colsum AS (SELECT value, sum(n) AS n, any_value(expected) AS expected FROM dense GROUP BY 1),
    score_all AS (SELECT CAST(sum(n) AS BIGINT) AS total, round(sum(abs(expected - n / (SELECT CAST(sum(n) AS DOUBLE) FROM dense))) / 2, 9) AS dp FROM colsum)
    """


BY_SOURCE = distribution(COMMON_WORDS, "source")
oracle(
    "flt10_removed_values",
    distribution("lemma IN ('and', 'in')", "source") + "SELECT * FROM scores",
    DOCS,
    TEXTS,
)
oracle("agg10_attribute_by_text", f"SELECT lemma AS attr, text_id, CAST(count(*) AS BIGINT) AS n FROM t WHERE {COMMON_WORDS} GROUP BY 1, 2", DOCS)
oracle("agg10_free_first_token", pair("true", "b.lemma = 'the'", "a.lemma AS attr, a.text_id, CAST(count(*) AS BIGINT) AS n") + " GROUP BY 1, 2", DOCS)
oracle(
    "agg11_category_totals",
    "SELECT quality AS value, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS n_texts FROM texts WHERE quality IS NOT NULL GROUP BY 1",
    TEXTS,
)
oracle(
    "agg11_many_to_many_totals",
    """SELECT brand AS value, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS n_texts
    FROM (SELECT DISTINCT text_id, brand FROM op WHERE size BETWEEN 1 AND 25) JOIN orders_t USING (text_id) WHERE status = 'O' GROUP BY 1""",
    SHOP,
)
oracle("agg12_distribution", BY_SOURCE + "SELECT * FROM cells", DOCS, TEXTS)
oracle(
    "agg12_many_to_many",
    """SELECT lemma AS attr, brand AS value, CAST(count(*) AS BIGINT) AS n
    FROM lines JOIN (SELECT DISTINCT text_id, brand FROM op) USING (text_id) GROUP BY 1, 2""",
    SHOP,
)
oracle(
    "agg12_spoken",
    f"""SELECT attr, value, n, n_tokens, n_texts
    FROM (SELECT lemma AS attr, role AS value, CAST(count(*) AS BIGINT) AS n FROM tt WHERE role <> 'system' AND lemma {COMMON} GROUP BY 1, 2)
    JOIN (SELECT role AS value, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(count(DISTINCT speaker) AS BIGINT) AS n_texts FROM seg GROUP BY 1) USING (value)""",
    TALK,
)
oracle(
    "agg18_searched_forms",
    """, li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k FROM lineitem),
    h AS (SELECT DISTINCT a.l_orderkey AS text_id, a.k, a.l_returnflag AS form FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey
      AND ((a.l_returnflag = 'R' AND b.k = a.k + 1) OR (a.l_returnflag = 'A' AND b.k BETWEEN a.k + 1 AND a.k + 2)) WHERE b.l_returnflag = 'N')
    SELECT form, place, CAST(count(*) AS BIGINT) AS n FROM h JOIN orders_t USING (text_id) WHERE status IN ('P', 'F') GROUP BY 1, 2""",
    SHOP,
)
oracle(
    "agg18_free_first_token",
    """, li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k FROM lineitem),
    h AS (SELECT a.l_orderkey AS text_id, a.l_returnflag AS form FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1
      WHERE b.l_returnflag = 'N')
    SELECT form, place, CAST(count(*) AS BIGINT) AS n FROM h JOIN orders_t USING (text_id) WHERE status IN ('P', 'F') GROUP BY 1, 2""",
    SHOP,
)
oracle(
    "agg13_totals",
    BY_SOURCE
    + """SELECT 'attr' AS level, attr, '' AS value, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY 2
    UNION ALL SELECT 'value', '', value, CAST(sum(n) AS BIGINT) FROM cells GROUP BY 3 UNION ALL SELECT 'all', '', '', CAST(sum(n) AS BIGINT) FROM cells""",
    DOCS,
    TEXTS,
)
oracle("agg14_deviation", BY_SOURCE + "SELECT * FROM scores", DOCS, TEXTS)
oracle("agg14_outside_categories", distribution("starts_with(lemma, 'thatin')", "toxic") + "SELECT * FROM scores", DOCS, TEXTS)
oracle("agg15_total_deviation", BY_SOURCE + "SELECT * FROM score_all", DOCS, TEXTS)
BY_SIZE = distribution("lemma = 'der'", "n_chars")
oracle(
    "agg16_zero_columns",
    BY_SIZE
    + """, c AS (SELECT CAST(value AS VARCHAR) AS value, CAST(coalesce(n, 0) AS BIGINT) AS n_hits, n_tokens, n_texts
      FROM totals LEFT JOIN (SELECT value, sum(n) AS n FROM cells GROUP BY 1) USING (value))
    SELECT *, 'kept' AS zeros FROM c UNION ALL SELECT *, 'dropped' FROM c WHERE n_hits > 0""",
    DOCS,
    TEXTS,
)
oracle(
    "agg17_number_order",
    """SELECT row_number() OVER (ORDER BY n_chars) - 1 AS column_no, CAST(n_chars AS VARCHAR) AS value, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
    FROM texts GROUP BY n_chars""",
    TEXTS,
)
oracle("agg18_geo_distribution", "SELECT word AS form, place, CAST(count(*) AS BIGINT) AS n FROM lines JOIN orders_t USING (text_id) GROUP BY 1, 2", SHOP)
oracle(
    "agg19_places_with_forms",
    "SELECT place, string_agg(form || ': ' || n, '; ' ORDER BY form) AS forms, lat, lng FROM geo JOIN coords USING (place) GROUP BY place, lat, lng",
    SHOP,
)
oracle(
    "agg20_forms_with_places",
    "SELECT form, string_agg(place || ': ' || n, '; ' ORDER BY n DESC, place) AS places, CAST(sum(n) AS BIGINT) AS total FROM geo GROUP BY 1",
    SHOP,
)
oracle(
    "agg21_marker_sets",
    """SELECT DISTINCT place, colour, lat, lng FROM geo
    JOIN (VALUES ('RF', 'red'), ('AF', 'red'), ('NO', 'blue'), ('RF', 'blue')) c(form, colour) USING (form) JOIN coords USING (place)""",
    SHOP,
)
oracle(
    "agg22_speakers_and_places",
    """SELECT CAST(count(*) AS BIGINT) AS n_speakers, CAST(count(DISTINCT place) AS BIGINT) AS n_places FROM orders_t
    WHERE status IN ('O', 'P') AND price BETWEEN 1000 AND 150000""",
    SHOP,
)

# ---------------------------------------------------------------- neighbours and sets

oracle(
    "win1_neighbours",
    """, w AS (SELECT *, lead(lemma) OVER s AS next_lemma, lag(word) OVER d AS b, lead(word, 2) OVER d AS a FROM t
      WINDOW s AS (PARTITION BY text_id, s_id ORDER BY tok_no), d AS (PARTITION BY text_id ORDER BY tok_no))
    SELECT text_id, tok_no AS hit_start, coalesce(b, '') AS before, coalesce(a, '') AS after FROM w WHERE lemma = 'of' AND next_lemma = 'the'""",
    DOCS,
)
oracle("win2_context_frame", kwic(pair("a.lemma = 'that'", "b.lemma = 'the'"), 2) + "SELECT text_id, s AS hit_start, left_text, right_text FROM k", DOCS)
oracle(
    "win3_match_offsets",
    f""", h AS (SELECT a.text_id, a.tok_no AS s, min(b.tok_no) AS e FROM t a
      JOIN t b ON {SAME.format("a", "b")} AND b.tok_no BETWEEN a.tok_no + 2 AND a.tok_no + 3 AND b.lemma = 'of' WHERE a.lemma = 'and' GROUP BY 1, 2)
    SELECT text_id, s AS hit_start, word FROM h JOIN t USING (text_id) WHERE tok_no = s + 1""",
    DOCS,
)
oracle("set1_union_of_patterns", per_text(where("starts_with(lemma, 'the') OR suffix(lemma, 'e')")), DOCS)
oracle(
    "set3_difference",
    f""", bt AS (SELECT lemma AS attr, text_id, CAST(count(*) AS BIGINT) AS n FROM t WHERE {COMMON_WORDS} GROUP BY 1, 2)
    SELECT * FROM bt WHERE attr NOT IN (SELECT attr FROM bt GROUP BY 1 HAVING sum(n) > 0.2 * (SELECT sum(n) FROM bt))""",
    DOCS,
)
oracle("set4_distinct", "SELECT DISTINCT place AS value FROM orders_t WHERE place IS NOT NULL", SHOP)
oracle(
    "set5_whole_order",
    "SELECT row_number() OVER (ORDER BY text_id, tok_no) - 1 AS hit_no, text_id, tok_no AS hit_start FROM t WHERE lemma = 'is'",
    DOCS,
)
oracle(
    "fun_text_helpers",
    """SELECT doc_id, CASE WHEN length(text) > 37 THEN substr(text, 1, 38) || '...' ELSE text END AS short, source,
    printf('%.2f', n_chars / 7.0::DOUBLE) AS seventh FROM documents""",
)

# ---------------------------------------------------------------- exports

oracle(
    "snk1_concordance_export",
    kwic(FROM_THE, 15)
    + """SELECT startpos + s AS "Corpus position", text_id || '.' || s_id AS "Sentence ID", source AS "Source",
    coalesce(CAST(quality AS VARCHAR), '') AS "Quality", left_text AS "Left context", match_text AS "Match", right_text AS "Right context"
    FROM k JOIN texts USING (text_id) JOIN (SELECT text_id, tok_no AS s, s_id FROM t) USING (text_id, s)""",
    DOCS,
    TEXTS,
)
oracle(
    "snk2_two_lines",
    f""", h AS ({FROM_THE}), k AS (
      SELECT h.text_id, s, any_value(source) AS source, string_agg(word, ' ' ORDER BY tok_no) AS w, string_agg(coalesce(phon, ''), ' ' ORDER BY tok_no) AS p,
        max(s_id) FILTER (WHERE tok_no = s) AS s_id
      FROM h JOIN t ON t.text_id = h.text_id AND tok_no BETWEEN s - 5 AND e + 5 GROUP BY 1, 2)
    SELECT text_id, s AS hit_start, concat_ws(' ', text_id || '.' || s_id, source, w) || chr(10) ||
      concat_ws(' ', text_id || '.' || s_id, source, p) || chr(10) AS lines FROM k""",
    DOCS,
)
oracle(
    "snk3_frequency_export",
    f"""SELECT CAST(count(*) AS BIGINT) AS "Count", word AS "Word form", lemma AS "Lemma" FROM t WHERE {COMMON_WORDS} GROUP BY 2, 3""",
    DOCS,
)
BY_LANGUAGE = distribution(COMMON_WORDS, "lang")
LANGUAGE = "CAST(sum(n) FILTER (WHERE value = '{0}') AS BIGINT) AS {0}"
LANGUAGES = ", ".join(LANGUAGE.format(v) for v in ("de", "en", "es", "fr"))
oracle(
    "snk4_distribution_export",
    BY_LANGUAGE
    + f"""SELECT attr AS attribute_value, {LANGUAGES}, total, printf('%.2f', dp) AS dp FROM dense JOIN scores USING (attr) GROUP BY attr, total, dp
    UNION ALL SELECT 'Total', {LANGUAGES}, any_value(total), printf('%.2f', any_value(dp)) FROM colsum, score_all""",
    DOCS,
    TEXTS,
)
oracle(
    "snk4_distribution_lines",
    BY_LANGUAGE
    + """, cols AS (SELECT row_number() OVER (ORDER BY value) AS k, value, n_tokens FROM totals),
    body AS (SELECT attr, string_agg(n::VARCHAR, chr(9) ORDER BY value) AS ns, any_value(total) AS total, any_value(dp) AS dp
      FROM dense JOIN scores USING (attr) GROUP BY attr),
    foot AS (SELECT string_agg(n, chr(9) ORDER BY value) AS ns FROM (SELECT value, sum(n)::BIGINT::VARCHAR AS n FROM dense GROUP BY value))
    SELECT 'Attribute value' || chr(9) || (SELECT string_agg(value || ' (' || n_tokens || ' tokens)', chr(9) ORDER BY k) FROM cols)
      || chr(9) || 'Total (' || (SELECT sum(n_tokens)::BIGINT FROM cols) || ' tokens)' || chr(9) || 'Deviation of proportions' AS line
    UNION ALL SELECT attr || chr(9) || ns || chr(9) || total || chr(9) || printf('%.2f', dp) FROM body
    UNION ALL SELECT 'Total' || chr(9) || ns || chr(9) || any_value(total) || chr(9) || printf('%.2f', any_value(score_all.dp))
      FROM foot, colsum, score_all GROUP BY ns""",
    DOCS,
    TEXTS,
)
oracle("snk4_distribution_titles", BY_LANGUAGE + "SELECT value || ' (' || n_tokens || ' tokens)' AS title FROM totals", DOCS, TEXTS)
oracle(
    "snk5_running_text",
    """SELECT text_id, tok_no // 4096 AS block, md5(string_agg(lemma, chr(10) ORDER BY tok_no)) AS text_md5,
    CAST(length(string_agg(lemma, chr(10) ORDER BY tok_no)) AS BIGINT) AS n_chars FROM t WHERE lang IN ('en', 'es') GROUP BY 1, 2""",
    DOCS,
)
