"""DuckDB SQL for the registered queries.

Each text is put together from named common table expressions; ``with_`` adds the ones they rest on.
"""

from __future__ import annotations

import re

from leafvoice.functions import fixed

CTE: dict[str, str] = {}
SQL: dict[str, str] = {}
RECURSIVE = "WITH RECURSIVE "


def _names(text: str) -> list[str]:
    return [n for n in CTE if re.search(rf"\b{n}\b", text)]


def with_(body: str) -> str:
    """``body`` preceded by every table expression it needs, in order of definition."""
    need, todo = set(), _names(body)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [m for m in _names(CTE[n]) if m != n]
    parts = [f"{n} AS ({CTE[n]})" for n in CTE if n in need]
    return (RECURSIVE + ",\n".join(parts) + "\n" if parts else "") + body


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ABBR = (
    r"(?i)(?:^|[^A-Za-z0-9_.])\.*(?:(?:" + "|".join(a.replace(".", r"\.") for a in fixed.ABBREVIATIONS)
    + r")|(?:[a-z]\.){1,4}[a-z]|[a-z])\.\s*$"
)
FOLLOW = "|".join(fixed.HYPHEN_FOLLOWERS)
MARK = "chr(64976)"  # U+FDD0


def abbr(x: str) -> str:
    return f"regexp_matches({x}, {q(ABBR)})"


def hyphens(x: str) -> str:
    keep = f"regexp_replace({x}, '([A-Za-z]{{2,}}[-‐‑­]) ({FOLLOW})([^a-z]|$)', '\\1' || {MARK} || '\\2\\3', 'g')"
    return f"replace(regexp_replace({keep}, '([A-Za-z]{{2,}})[-‐‑­] ([a-z]{{2,}})', '\\1\\2', 'g'), {MARK}, ' ')"


def strip(x: str) -> str:
    for pat in (fixed.CODE_FENCE, fixed.LATEX_BLOCK, fixed.LATEX_INLINE, fixed.BOX_DRAWING):
        x = f"regexp_replace({x}, {q(pat)}, ' ', 'g')"
    x = f"replace({x}, '­', '')"
    x = f"regexp_replace({x}, '-\n([a-z])', '\\1', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def ligatures(name: str, src: str, keys: str, x: str) -> None:
    """Defines ``name(keys, text)``: ``x`` of ``src`` with lost ligatures restored."""
    CTE[f"{name}_tok"] = f"""
      SELECT {keys}, i, t[i] AS tok, regexp_extract(t[i], '^([^A-Za-z]*)([A-Za-z]+)([^A-Za-z]*)$', 1) AS pre,
        regexp_extract(t[i], '^([^A-Za-z]*)([A-Za-z]+)([^A-Za-z]*)$', 2) AS core,
        regexp_extract(t[i], '^([^A-Za-z]*)([A-Za-z]+)([^A-Za-z]*)$', 3) AS post
      FROM (SELECT {keys}, t, unnest(range(1, len(t) + 1)) AS i
            FROM (SELECT {keys}, regexp_extract_all({x}, '\\s+|\\S+') AS t FROM {src}))"""
    CTE[f"{name}_near"] = f"""
      SELECT *, lead(tok) OVER w AS sep, lead(core, 2) OVER w AS core2, lead(pre, 2) OVER w AS pre2, lead(post, 2) OVER w AS post2
      FROM {name}_tok WINDOW w AS (PARTITION BY {keys} ORDER BY i)"""
    CTE[f"{name}_hit"] = f"""
      SELECT n.*, p.lig, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS r
      FROM {name}_near n JOIN ligature_pairs p ON p.pair = lower(core) || ' ' || lower(core2)
      WHERE sep = ' ' AND post = '' AND pre2 = '' AND core <> '' AND core2 <> ''"""
    CTE[f"{name}_join"] = f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, i - 2 * r ORDER BY i) AS k FROM {name}_hit) WHERE k % 2 = 1"""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    CTE[f"{name}_fix"] = f"""
      SELECT {", ".join("a." + k for k in keys.split(", "))}, a.i,
        CASE WHEN b.i = a.i THEN b.pre || b.core || b.lig || b.core2 || b.post2 WHEN b.i IS NOT NULL THEN ''
             WHEN t.lig IS NOT NULL THEN a.pre || t.lig || a.core || a.post ELSE a.tok END AS tok
      FROM {name}_tok a LEFT JOIN {name}_join b ON {on} AND a.i BETWEEN b.i AND b.i + 2
      LEFT JOIN ligature_tails t ON t.tail = lower(a.core)"""
    CTE[name] = f"SELECT {keys}, regexp_replace(string_agg(tok, '' ORDER BY i), ' {{2,}}', ' ', 'g') AS text FROM {name}_fix GROUP BY {keys}"


def simple_split(name: str, src: str, keys: str, x: str) -> None:
    """Defines ``name(keys, pos, text)``: ``x`` of ``src`` cut by the simple splitter."""
    CTE[f"{name}_fold"] = f"""
      SELECT {keys}, list_reduce(list_transform(string_split(
          regexp_replace({x}, '([.!?]\\.*)(\\s*[A-Z"''(\\[])', '\\1' || {MARK} || '\\2', 'g'), {MARK}),
          lambda p: {{'b': p, 'o': []::VARCHAR[]}}),
        lambda a, p: CASE WHEN {abbr("trim(a.b || p.b)")} THEN {{'b': a.b || p.b, 'o': a.o}}
          ELSE {{'b': '', 'o': list_append(a.o, trim(a.b || p.b))}} END, {{'b': '', 'o': []::VARCHAR[]}}) AS f
      FROM {src}"""
    CTE[name] = f"""
      SELECT {keys}, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, unnest(s) AS text
      FROM (SELECT {keys}, list_filter(list_append(f.o, trim(f.b)), lambda p: p <> '') AS s FROM {name}_fold)"""


CLOSERS = "[\"'()\\[\\]{}‘’“”«»‹›]"


def unicode_pieces(x: str) -> tuple[str, str]:
    """The candidates ``c`` of ``x`` and the pieces made of them: every end mark with what closes it is a
    candidate, and the text on both sides (``p.s`` and ``p.n``) decides."""
    candidates = f"string_split(regexp_replace({x}, {q('([.!?]+' + CLOSERS + '* *)')}, '\\1' || {MARK}, 'g'), {MARK})"
    closed = f"regexp_matches(p.s, {q('[.!?]' + CLOSERS + '* +$')}) OR regexp_matches(p.s, {q('[.!?]' + CLOSERS + '+ *$')})"
    joins = "regexp_matches(p.n, '^[.!?,:;\\-–—]')"
    strong = f"regexp_matches(p.s, {q('[!?]' + CLOSERS + '* *$')})"
    # What goes on behind a mark is looked at behind all that closes it.
    ends = (
        f"CASE WHEN p.n IS NULL OR {joins} THEN false WHEN {strong} THEN true "
        f"WHEN regexp_matches(p.n, '^[^\\p{{L}}.!?]*\\p{{Ll}}') THEN false WHEN {closed} THEN true "
        f"ELSE NOT (regexp_matches(p.n, '^[0-9]') OR (regexp_matches(p.s, '\\p{{L}}\\.$') AND regexp_matches(p.n, '^\\p{{Lu}}'))) END"
    )
    pieces = (
        f"list_transform(list_transform(range(1, len(c) + 1), lambda i: {{'s': c[i], 'n': nullif(c[i + 1], '')}}), "
        f"lambda p: CASE WHEN {ends} THEN p.s || {MARK} ELSE p.s END)"
    )
    return pieces, candidates


def unicode_split(name: str, src: str, keys: str, x: str, merge: bool = True) -> None:
    """Defines ``name(keys, pos, text)``: ``x`` of ``src`` cut by the Unicode rules."""
    pieces, candidates = unicode_pieces(x)
    clean = lambda s: f"list_filter(list_transform(string_split(array_to_string({s}, ''), {MARK}), lambda t: trim(t)), lambda t: t <> '')"
    CTE[f"{name}_cand"] = f"SELECT {keys}, {candidates} AS c FROM {src}"
    CTE[f"{name}_seg"] = f"SELECT {keys}, {clean(pieces)} AS s FROM {name}_cand"
    glued = f"list_transform(s, lambda t: t || CASE WHEN {abbr('t')} THEN ' ' ELSE {MARK} END)"
    CTE[f"{name}_all"] = f"SELECT {keys}, {clean(glued) if merge else 's'} AS s FROM {name}_seg"
    CTE[name] = f"SELECT {keys}, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, unnest(s) AS text FROM {name}_all"


def capped(name: str, src: str, keys: str, x: str = "text") -> None:
    """Defines ``name(keys, part, text)``: ``x`` of ``src`` cut to 350 characters."""
    n = fixed.MAX_SENTENCE_CHARS
    at = lambda pat: f"nullif(length(regexp_extract(left(rest, {n + 1}), {q(pat)}, 1)), 0)"
    cut = "coalesce(" + ", ".join(at(p) for p in (
        f"(?s)^(.{{0,{n - 1}}}[.!?])\\s", f"(?s)^(.{{0,{n - 1}}}[;:—])\\s", f"(?s)^(.{{0,{n - 1}}},)\\s", f"(?s)^(.{{0,{n - 1}}}\\s)\\S"
    )) + f", {n})"
    CTE[f"{name}_cut"] = f"""
      SELECT {keys}, 0 AS part, CAST(NULL AS VARCHAR) AS text, trim({x}) AS rest FROM {src}
      UNION ALL
      SELECT {keys}, part + 1, CASE WHEN length(rest) <= {n} THEN rest ELSE trim(left(rest, c)) END,
        CASE WHEN length(rest) <= {n} THEN '' ELSE trim(substr(rest, c + 1)) END
      FROM (SELECT *, CASE WHEN length(rest) > {n} THEN {cut} END AS c FROM {name}_cut WHERE rest <> '')"""
    CTE[name] = f"SELECT {keys}, part, text FROM {name}_cut WHERE part > 0 AND text <> ''"


# --- inputs ----------------------------------------------------------------------------------

# What a lost ligature leaves of each listed word; of several ligatures the first in the list repairs it.
CTE["listed_words"] = "SELECT col0 AS word FROM (VALUES " + ", ".join(f"({q(w)})" for w in sorted(set(fixed.LIGATURE_WORDS))) + ")"
CTE["listed_ligatures"] = "SELECT col0 AS lig, col1 AS ord FROM (VALUES " + ", ".join(f"({q(x)}, {i})" for i, x in enumerate(fixed.LIGATURES)) + ")"
CTE["never_tails"] = "SELECT col0 AS word FROM (VALUES " + ", ".join(f"({q(w)})" for w in sorted(set(fixed.NEVER_EXTEND))) + ")"
CTE["word_cuts"] = """
  SELECT lig, ord, left(word, i) AS head, substr(word, i + length(lig) + 1) AS tail
  FROM (SELECT word, lig, ord, unnest(range(0, length(word))) AS i FROM listed_words, listed_ligatures) WHERE substr(word, i + 1, length(lig)) = lig"""
CTE["ligature_pairs"] = """
  SELECT head || ' ' || tail AS pair, arg_min(lig, ord) AS lig FROM word_cuts
  WHERE head <> '' AND tail <> '' AND tail NOT IN (SELECT word FROM never_tails) GROUP BY 1"""
CTE["ligature_tails"] = """
  SELECT tail, arg_min(lig, ord) AS lig FROM word_cuts
  WHERE head = '' AND tail <> '' AND tail NOT IN (SELECT word FROM never_tails) AND tail NOT IN (SELECT word FROM listed_words) GROUP BY 1"""
CTE["lines"] = """
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i - 1 AS BIGINT) AS para_idx, CAST((i - 1) // 20 + 1 AS INTEGER) AS page, ls[i] AS text
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents))"""
CTE["spoken"] = """
  SELECT doc_id, para_idx // 5 AS chapter_idx, 'ch_' || (para_idx // 5 + 1) AS chapter_id, para_idx % 5 AS sentence_idx,
    para_idx AS global_idx, text FROM lines"""
CTE["docs"] = """
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, source || '_' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.PDF' ELSE '.pdf' END AS file_name,
    CASE WHEN doc_id % 3 <> 0 THEN trim(string_split(text, chr(10))[1]) ELSE ' ' END AS meta_title,
    CAST(greatest(1, n_chars // 60) AS INTEGER) AS page_count FROM documents"""
CTE["titled"] = "SELECT *, coalesce(nullif(trim(meta_title), ''), regexp_replace(file_name, '(?i)\\.pdf$', '')) AS title FROM docs"
CTE["shelf"] = """
  SELECT 'bk_' || substr(sha256(doc_id), 1, 11) AS book_id, doc_id, title, file_name, page_count, chapter_count, sentence_count,
    (1704067200 + CAST(doc_id AS BIGINT) % 500 * 60) * 1000 AS added_at
  FROM titled JOIN (SELECT doc_id, count(DISTINCT chapter_idx) AS chapter_count, count(*) AS sentence_count FROM spoken GROUP BY doc_id) USING (doc_id)"""
CTE["saved"] = """
  SELECT 'bk_' || substr(sha256(json_extract_string(props, '$.k')), 1, 11) AS book_id, json_extract_string(props, '$.k') AS doc_id,
    user_id AS reader_id, event_id, 'ch_' || (event_id % 4 + 1) AS chapter_id, event_id % 5 AS sentence_idx, value AS offset_sec,
    CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value) AS INTEGER) END AS char_index, ts AS updated_at FROM events"""
CTE["last_saved"] = "SELECT * FROM saved QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC, event_id DESC) = 1"
CTE["bought"] = """
  SELECT DISTINCT 'bk_' || substr(sha256(json_extract_string(props, '$.k')), 1, 11) AS book_id FROM events
  WHERE event_type = 'purchase' AND value > 100"""
CTE["words"] = """
  SELECT doc_id, page, para_idx, ws[i] AS str, i - 1 AS w, len(ws) AS n FROM (
    SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (
      SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM lines))"""
CTE["items"] = """
  SELECT doc_id, page, CAST(para_idx % 20 * 10000 + w AS INTEGER) AS item_idx, str,
    CASE WHEN w % 7 = 0 THEN 12.4 ELSE 11.0 END::DOUBLE AS size, (72.0 + w * 80.0)::DOUBLE AS x,
    (800.0 - para_idx % 20 * 14 - w % 3 * 0.75)::DOUBLE AS y,
    (CASE WHEN w % 5 = 0 THEN 0.0 WHEN w % 5 = 1 THEN 80.0 ELSE length(str) * 5.0 END)::DOUBLE AS width,
    w = n - 1 AND para_idx % 4 <> 3 AS has_eol FROM words"""
CTE["word_runs"] = """
  SELECT doc_id, page, item_idx * 2 AS run_idx, str AS text, size AS font_size, x, y, width FROM items
  UNION ALL SELECT doc_id, page, item_idx * 2 + 1, chr(10), size, x, y, 0.0 FROM items WHERE has_eol"""
CTE["run_pages"] = "SELECT doc_id, page, list({'run_idx': run_idx, 'y': y, 'eol': text = chr(10)} ORDER BY run_idx) AS rs FROM word_runs GROUP BY doc_id, page"
CTE["run_lines"] = """
  SELECT doc_id, page, unnest(rs, recursive := true), unnest(f.o) AS line FROM (
    SELECT doc_id, page, rs, list_reduce(list_transform(rs, lambda r: {'l': CASE WHEN r.eol THEN 1 ELSE 0 END, 'a': r.y, 'o': []::INTEGER[]}),
      lambda s, r: CASE WHEN r.l = 1 THEN {'l': s.l, 'a': NULL, 'o': list_append(s.o, -1)}
        WHEN abs(s.a - r.a) <= 1.5 THEN {'l': s.l, 'a': s.a, 'o': list_append(s.o, s.l)}
        ELSE {'l': s.l + 1, 'a': r.a, 'o': list_append(s.o, s.l + 1)} END,
      {'l': -1, 'a': NULL::DOUBLE, 'o': []::INTEGER[]}) AS f FROM run_pages)"""
CTE["lined"] = """
  SELECT r.*, l.line FROM word_runs r JOIN (SELECT doc_id, page, run_idx, line FROM run_lines WHERE line >= 0) l USING (doc_id, page, run_idx)"""
CTE["pieces"] = """
  SELECT *, CASE WHEN x - lag(x + CASE WHEN coalesce(width, 0) = 0 THEN length(text) * font_size * 0.5 ELSE width END) OVER w > font_size * 0.2
      AND NOT regexp_matches(lag(text) OVER w, '\\s$') AND NOT regexp_matches(text, '^\\s') THEN ' ' || text ELSE text END AS piece
  FROM lined WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY run_idx)"""
CTE["line_sizes"] = """
  SELECT doc_id, page, line, size AS font_size FROM (
    SELECT doc_id, page, line, floor(font_size * 2 + 0.5) / 2 AS size, sum(greatest(1, length(trim(text)))) AS chars, min(run_idx) AS f
    FROM lined GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, page, line ORDER BY chars DESC, f) = 1"""
CTE["text_lines"] = """
  SELECT doc_id, page, line, first(y ORDER BY run_idx) AS y, string_agg(piece, '' ORDER BY run_idx) AS text, any_value(s.font_size) AS font_size
  FROM pieces p JOIN line_sizes s USING (doc_id, page, line) GROUP BY doc_id, page, line"""
CTE["line_pages"] = """
  SELECT doc_id, page, list({'line': line, 'y': y, 'size': font_size, 'text': trim(text)} ORDER BY line) AS ls FROM text_lines GROUP BY doc_id, page"""
CTE["line_paras"] = """
  SELECT doc_id, page, unnest(ls, recursive := true), unnest(f.o) AS seq FROM (
    SELECT doc_id, page, ls, list_reduce(list_transform(ls, lambda l: {'p': CASE WHEN l.text = '' THEN 1 ELSE 0 END, 'y': l.y, 's': l.size, 'o': []::INTEGER[]}),
      lambda a, l: CASE WHEN l.p = 1 THEN {'p': a.p, 'y': NULL, 's': NULL, 'o': list_append(a.o, -1)}
        WHEN a.s IS NULL OR abs(a.y - l.y) > (CASE WHEN l.s = 0 THEN 14 ELSE l.s * 1.4 END) * 1.6
          OR (a.s > 0 AND abs(l.s - a.s) > greatest(1, a.s * 0.08))
          THEN {'p': a.p + 1, 'y': l.y, 's': l.s, 'o': list_append(a.o, a.p + 1)}
        ELSE {'p': a.p, 'y': l.y, 's': a.s, 'o': list_append(a.o, a.p)} END,
      {'p': -1, 'y': NULL::DOUBLE, 's': NULL::DOUBLE, 'o': []::INTEGER[]}) AS f FROM line_pages)"""
_FOLLOWS = ", ".join(q(w) for w in fixed.HYPHEN_FOLLOWERS)
CTE["raw_paras"] = f"""
  SELECT doc_id, page, seq, first(size ORDER BY line) AS font_size, list_reduce(list(text ORDER BY line),
    lambda a, b: CASE WHEN regexp_matches(a, '[A-Za-z]-$') AND lower(regexp_extract(b, '^[A-Za-z]+')) NOT IN ({_FOLLOWS})
      THEN CASE WHEN regexp_matches(b, '^[A-Z]') THEN a || b ELSE left(a, length(a) - 1) || b END ELSE a || ' ' || b END) AS text
  FROM line_paras WHERE seq >= 0 GROUP BY doc_id, page, seq"""

# Web pages as books.
CTE["html_lines"] = r"""
  SELECT CAST(page_id // 10 AS VARCHAR) AS doc_id, CAST(page_id % 10 + 1 AS INTEGER) AS page, i, ls[i] AS line FROM (
    SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
      SELECT page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?s)<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->', '', 'g'), '\s+', ' ', 'g'), '<h1[^>]*>', chr(10) || '#H ', 'g'),
        '</?(p|li|nav|footer|ul|ol|div|article|h1|h2|h3|body|head|table|tr|br)[^>a-z]*[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
        lambda x: trim(x)), lambda x: x <> '') AS ls FROM pages))"""
CTE["web"] = """
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS para_idx, page, text, font_size FROM (
    SELECT doc_id, page, i, CASE WHEN line LIKE '#H %' THEN trim(substr(line, 4)) WHEN line = '#H' THEN line ELSE line END AS text,
      CASE WHEN line LIKE '#H %' THEN 22.0 ELSE 11.0 END::DOUBLE AS font_size FROM html_lines) WHERE text <> ''"""
CTE["chromeless"] = """
  SELECT w.* FROM web w JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM web GROUP BY doc_id) d USING (doc_id)
  LEFT JOIN (SELECT doc_id, text, count(*) AS n FROM web WHERE length(text) <= 80 GROUP BY doc_id, text) c ON c.doc_id = w.doc_id AND c.text = w.text
  WHERE NOT (pages >= 4 AND coalesce(n, 0) >= greatest(2, floor(pages * 0.4)))
    AND NOT (length(trim(w.text)) <= 4 AND regexp_matches(trim(w.text), '(?i)^[0-9ivxlcdm]+$'))"""


def sections(pre: str, src: str, outline: str | None, max_words: int) -> None:
    """Defines ``{pre}_members(doc_id, para_idx, mode, key)`` and ``{pre}_chapters`` over ``src``."""
    heading = f"(regexp_matches(trim(text), {q(fixed.NUMBERED_HEADING)}) OR regexp_matches(trim(text), {q(fixed.NAMED_HEADING)}))"
    CTE[f"{pre}_weights"] = f"SELECT doc_id, font_size, sum(greatest(1, floor(length(text) / 20 + 0.5)))::BIGINT AS w FROM {src} WHERE font_size > 0 GROUP BY ALL"
    CTE[f"{pre}_median"] = f"""
      SELECT doc_id, min(font_size) FILTER (c > total // 2) AS median_size, max(total)::BIGINT AS weight_total FROM (
        SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY font_size) AS c, sum(w) OVER (PARTITION BY doc_id) AS total FROM {pre}_weights) GROUP BY doc_id"""
    CTE[f"{pre}_cand"] = f"""
      SELECT p.doc_id, para_idx, page, text, row_number() OVER (PARTITION BY p.doc_id ORDER BY para_idx) AS r
      FROM {src} p JOIN {pre}_median m ON m.doc_id = p.doc_id
      JOIN (SELECT doc_id, count(*) AS paras FROM {src} GROUP BY doc_id) n ON n.doc_id = p.doc_id
      WHERE paras >= 4 AND weight_total >= 4 AND ((font_size >= median_size * 1.25 AND length(text) < 100
        AND len(regexp_split_to_array(trim(text), '\\s+')) <= 14 AND regexp_matches(text, '[A-Za-z]')) OR {heading})"""
    CTE[f"{pre}_heads"] = f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx - r ORDER BY para_idx) AS k FROM {pre}_cand) WHERE k % 2 = 1"""
    CTE[f"{pre}_under"] = f"""
      SELECT * FROM (SELECT p.doc_id, p.para_idx, p.page, p.text, max(h.para_idx) OVER (PARTITION BY p.doc_id ORDER BY p.para_idx) AS key,
        h.para_idx IS NOT NULL AS is_head FROM {src} p LEFT JOIN {pre}_heads h ON h.doc_id = p.doc_id AND h.para_idx = p.para_idx)
      WHERE key IS NOT NULL AND NOT is_head"""
    CTE[f"{pre}_entries"] = "SELECT NULL::VARCHAR AS doc_id, 0 AS page, '' AS title LIMIT 0" if outline is None else f"""
      SELECT doc_id, page, title FROM {outline} WHERE doc_id IN (SELECT doc_id FROM {outline} GROUP BY doc_id HAVING count(*) >= 3)
      QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY entry_idx DESC) = 1"""
    CTE[f"{pre}_listed"] = f"""
      SELECT p.doc_id, p.para_idx, p.page, e.page AS key FROM {src} p ASOF JOIN {pre}_entries e ON p.doc_id = e.doc_id AND p.page >= e.page"""
    CTE[f"{pre}_parts"] = f"""
      SELECT doc_id, unnest(ids) AS para_idx, unnest(pages) AS page, unnest(f.o) AS key FROM (
        SELECT doc_id, ids, pages, list_reduce(list_transform(ws, lambda w: {{'w': w, 'n': 0, 'o': []::BIGINT[]}}),
          lambda a, b: CASE WHEN a.w + b.w >= {max_words} THEN {{'w': 0, 'n': a.n + 1, 'o': list_append(a.o, a.n)}}
            ELSE {{'w': a.w + b.w, 'n': a.n, 'o': list_append(a.o, a.n)}} END, {{'w': 0, 'n': 0, 'o': []::BIGINT[]}}) AS f
        FROM (SELECT doc_id, list(para_idx ORDER BY para_idx) AS ids, list(page ORDER BY para_idx) AS pages,
            list(len(regexp_split_to_array(text, '\\s+')) ORDER BY para_idx) AS ws FROM {src} GROUP BY doc_id))"""
    CTE[f"{pre}_modes"] = f"""
      SELECT doc_id, CASE WHEN coalesce(e, 0) >= 3 THEN 'outline' WHEN coalesce(hs, 0) >= 3 AND coalesce(h, 0) >= 3 THEN 'heading' ELSE 'wordSplit' END AS mode
      FROM (SELECT DISTINCT doc_id FROM {src}) LEFT JOIN (SELECT doc_id, count(DISTINCT key) AS e FROM {pre}_listed GROUP BY doc_id) USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(DISTINCT key) AS h FROM {pre}_under GROUP BY doc_id) USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS hs FROM {pre}_heads GROUP BY doc_id) USING (doc_id)"""
    CTE[f"{pre}_members"] = f"""
      SELECT doc_id, para_idx, page, mode, CAST(key AS BIGINT) AS key FROM (
        SELECT doc_id, para_idx, page, 'outline' AS mode, key FROM {pre}_listed UNION ALL SELECT doc_id, para_idx, page, 'heading', key FROM {pre}_under
        UNION ALL SELECT doc_id, para_idx, page, 'wordSplit', key FROM {pre}_parts) JOIN {pre}_modes USING (doc_id, mode)"""
    numbered(pre, f"{pre}_members")


def numbered(pre: str, members: str) -> None:
    """Defines ``{pre}_chapters`` from members with mode and key; headings and entries give the titles."""
    CTE.pop(f"{pre}_chapters", None)
    CTE[f"{pre}_chapters"] = f"""
      SELECT m.doc_id, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.key) - 1 AS chapter_idx, m.key,
        'ch_' || row_number() OVER (PARTITION BY m.doc_id ORDER BY m.key) AS chapter_id,
        CASE mode WHEN 'wordSplit' THEN 'Part ' || (m.key + 1) WHEN 'heading' THEN left(trim(h.text), 200) ELSE coalesce(nullif(e.title, ''), 'Untitled') END AS title,
        CAST(CASE mode WHEN 'wordSplit' THEN first_page WHEN 'heading' THEN h.page ELSE e.page END AS INTEGER) AS start_page, mode AS detection_mode, paragraphs
      FROM (SELECT doc_id, mode, key, min(page) AS first_page, count(*) AS paragraphs FROM {members} GROUP BY ALL) m
      LEFT JOIN {pre}_heads h ON mode = 'heading' AND h.doc_id = m.doc_id AND h.para_idx = m.key
      LEFT JOIN {pre}_entries e ON mode = 'outline' AND e.doc_id = m.doc_id AND e.page = m.key"""


def joined(pre: str, src: str, members: str) -> None:
    """Defines ``{pre}_text(doc_id, key, text)``: the blocks of each chapter joined."""
    CTE[f"{pre}_text"] = f"""
      SELECT doc_id, key, string_agg(t || CASE WHEN nxt IS NULL THEN '' WHEN regexp_matches(t, '[.!?:;,—-][)"''\\s]*$') OR regexp_matches(nxt, '^[a-z0-9]')
        THEN ' ' ELSE '. ' END, '' ORDER BY para_idx) AS text
      FROM (SELECT m.doc_id, m.key, m.para_idx, trim(p.text) AS t, lead(trim(p.text)) OVER (PARTITION BY m.doc_id, m.key ORDER BY m.para_idx) AS nxt
        FROM {members} m JOIN {src} p ON p.doc_id = m.doc_id AND p.para_idx = m.para_idx)
      GROUP BY doc_id, key"""


def sentence_rows(pre: str, splitter=None, base: str | None = None, repaired: str | None = None) -> None:
    """Defines ``{pre}_sentences`` from the text and chapters of ``base``; ``repaired`` selects the documents to repair."""
    base = base or pre
    CTE[f"{pre}_hyph"] = f"SELECT doc_id, key, {hyphens('text')} AS text FROM {base}_text" + (f" WHERE doc_id IN ({repaired})" if repaired else "")
    ligatures(f"{pre}_lig", f"{pre}_hyph", "doc_id, key", "text")
    rest = f" UNION ALL SELECT doc_id, key, text FROM {base}_text WHERE doc_id NOT IN ({repaired})" if repaired else ""
    CTE[f"{pre}_clean"] = f"SELECT doc_id, key, {strip('text')} AS text FROM (SELECT doc_id, key, text FROM {pre}_lig{rest})"
    (splitter or simple_split)(f"{pre}_split", f"{pre}_clean", "doc_id, key", "text")
    capped(f"{pre}_cap", f"{pre}_split", "doc_id, key, pos")
    CTE[f"{pre}_sentences"] = f"""
      SELECT doc_id, chapter_idx, chapter_id, row_number() OVER (PARTITION BY doc_id, chapter_idx ORDER BY pos, part) - 1 AS sentence_idx,
        row_number() OVER (PARTITION BY doc_id ORDER BY chapter_idx, pos, part) - 1 AS global_idx, text
      FROM {pre}_cap JOIN {base}_chapters USING (doc_id, key)"""


CTE["web_outline"] = "SELECT doc_id, para_idx AS entry_idx, text AS title, page FROM web WHERE font_size = 22"
CTE["half_outline"] = "SELECT * FROM web_outline WHERE CAST(doc_id AS BIGINT) % 2 = 0"
sections("book", "web", "half_outline", 3000)
joined("book", "web", "book_members")
sentence_rows("book")
sentence_rows("unibook", unicode_split, "book")
sections("toc", "web", "web_outline", 3000)
CTE["toc_members2"] = "SELECT doc_id, para_idx, page, 'outline' AS mode, key FROM toc_listed"
numbered("toc", "toc_members2")
sections("plain", "web", None, 3000)
CTE["plain_members2"] = "SELECT doc_id, para_idx, page, 'heading' AS mode, key FROM plain_under WHERE doc_id IN (SELECT doc_id FROM plain_heads GROUP BY doc_id HAVING count(*) >= 3)"
numbered("plain", "plain_members2")
CTE["lines11"] = "SELECT *, 11.0::DOUBLE AS font_size FROM lines"
sections("text", "lines11", None, 3000)
joined("text", "lines11", "text_members")
sentence_rows("text")
sections("bits", "lines11", None, 200)
CTE["bits_members2"] = "SELECT doc_id, para_idx, page, 'wordSplit' AS mode, key FROM bits_parts"
numbered("bits", "bits_members2")
sections("solo", "web", None, 3000)
joined("solo", "web", "solo_members")
sentence_rows("solo")
# Documents as runs lose headers and page numbers on the way.
CTE["laid"] = """
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS para_idx, page, text, 11.0::DOUBLE AS font_size FROM (
    SELECT w.* FROM lines w JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY doc_id) d USING (doc_id)
    LEFT JOIN (SELECT doc_id, text, count(*) AS n FROM lines WHERE length(text) <= 80 GROUP BY doc_id, text) c ON c.doc_id = w.doc_id AND c.text = w.text
    WHERE NOT (pages >= 4 AND coalesce(n, 0) >= greatest(2, floor(pages * 0.4)))
      AND NOT (length(trim(w.text)) <= 4 AND regexp_matches(trim(w.text), '(?i)^[0-9ivxlcdm]+$')))"""
sections("run", "laid", None, 3000)
joined("run", "laid", "run_members")
sentence_rows("run")

# --- sources and sinks -----------------------------------------------------------------------

SQL["read_runs"] = with_("""
SELECT doc_id, page, count(*) * 2 AS runs, sum(length(text) + 1)::BIGINT AS chars, round(sum(length(text) * 5.5), 6)::DOUBLE AS width FROM lines GROUP BY doc_id, page""")
SQL["normalize_raw_items"] = with_("SELECT doc_id, page, run_idx, text, font_size, x, round(y, 6) AS y, width FROM word_runs")
SQL["resolve_title"] = with_("SELECT doc_id, file_name, title FROM titled")
SQL["accept_files"] = """
SELECT page_id, file_name, CASE WHEN lower(file_name) LIKE '%.pdf' THEN NULL ELSE 'Please choose a PDF file.' END AS reason
FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.Pdf' ELSE '' END AS file_name FROM pages)"""
SQL["split_scanned"] = with_("""
SELECT doc_id, page_count, round(coalesce(c, 0) / page_count, 6) AS chars_per_page, page_count >= 3 AND coalesce(c, 0) / page_count < 50 AS scanned
FROM docs LEFT JOIN (SELECT doc_id, sum(length(text) + 1)::DOUBLE AS c FROM lines GROUP BY doc_id) USING (doc_id)""")
SQL["flatten_outline"] = """
SELECT CAST(page_id // 10 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS entry_idx, url AS title,
  CAST(page_id % 10 + 1 AS INTEGER) AS page FROM pages WHERE page_id % 7 <> 3"""
SQL["flatten_deep_outline"] = """
SELECT CAST(page_id // 100 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS entry_idx, url AS title,
  CAST(page_id % 100 + 1 AS INTEGER) AS page FROM pages WHERE page_id % 7 <> 3"""
SQL["write_library"] = with_("""
SELECT 'bk_' || substr(sha256(c.doc_id), 1, 11) AS book_id, c.doc_id, 'book ' || c.doc_id AS title, chapter_count, coalesce(n, 0) AS sentence_count, detection_mode, 'v1' AS voice,
  chapter_count AS chapters_stored, title_chars AS chapters_chars, n AS sentences_stored, chars AS sentences_chars
FROM (SELECT doc_id, count(*) AS chapter_count, sum(length(title))::BIGINT AS title_chars, any_value(detection_mode) AS detection_mode FROM solo_chapters GROUP BY doc_id) c
LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM solo_sentences GROUP BY doc_id) s ON s.doc_id = c.doc_id""")
SQL["book_id"] = "SELECT doc_id, 'bk_' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 11) AS book_id FROM documents"
SQL["list_books"] = with_("SELECT book_id, doc_id, title, chapter_count, sentence_count, added_at FROM shelf ORDER BY added_at DESC, doc_id")
SQL["get_content"] = with_("""
SELECT book_id, global_idx, text FROM (SELECT 'bk_' || substr(sha256(doc_id), 1, 11) AS book_id, global_idx, text FROM spoken) WHERE book_id IN (SELECT book_id FROM bought)""")
SQL["get_book"] = with_("SELECT book_id, doc_id, title, sentence_count FROM shelf WHERE book_id = 'bk_6b86b273ff3'")
SQL["update_book_field"] = with_("""
SELECT s.book_id, CASE WHEN b.book_id IS NOT NULL THEN 'voice-' || substr(s.book_id, 4, 2) END AS voice, title FROM shelf s LEFT JOIN bought b ON b.book_id = s.book_id""")
SQL["delete_books"] = with_("""
SELECT store, book_id, count(*) AS n FROM (SELECT 'books' AS store, book_id FROM shelf
  UNION ALL SELECT 'sentences', 'bk_' || substr(sha256(doc_id), 1, 11) FROM spoken UNION ALL SELECT 'progress', book_id FROM saved)
WHERE book_id NOT IN (SELECT book_id FROM bought) GROUP BY ALL""")
SQL["chunk_key"] = with_("SELECT event_id, book_id || '::' || chapter_id || '::' || sentence_idx AS chunk_key FROM saved")
SQL["get_chunk"] = with_("SELECT event_id, 'v' || event_id AS voice, offset_sec AS duration FROM saved WHERE book_id = 'bk_6b86b273ff3' AND chapter_id = 'ch_2' AND sentence_idx = 1")
SQL["upsert_chunks"] = with_("""
SELECT book_id, chapter_id, sentence_idx, 'v' || event_id AS voice, offset_sec AS duration FROM saved
QUALIFY row_number() OVER (PARTITION BY book_id, chapter_id, sentence_idx ORDER BY event_id % 2 DESC, updated_at DESC) = 1""")
SQL["count_chunks_by_book"] = with_("SELECT s.book_id, count(c.book_id) AS chunks FROM shelf s LEFT JOIN saved c ON c.book_id = s.book_id GROUP BY s.book_id")
SQL["clear_chunks"] = with_("SELECT event_id, book_id FROM saved WHERE book_id NOT IN (SELECT book_id FROM bought)")
SQL["latest_progress"] = with_("SELECT book_id, event_id, chapter_id, sentence_idx, offset_sec, char_index FROM last_saved")
SQL["latest_position_stream"] = SQL["latest_progress"]

# --- functions -------------------------------------------------------------------------------

SQL["line_predicates"] = with_(f"""
SELECT doc_id, para_idx, length(trim(text)) <= 4 AND regexp_matches(trim(text), '(?i)^[0-9ivxlcdm]+$') AS page_number,
  regexp_matches(trim(text), {q(fixed.NUMBERED_HEADING)}) OR regexp_matches(trim(text), {q(fixed.NAMED_HEADING)}) AS named_heading,
  regexp_matches(trim(text), '^[A-Z]$') AS drop_cap, regexp_matches(trim(text), '^[a-z]') AS continuation,
  regexp_matches(text, '[.!?:;,—-][)"''\\s]*$') AS ends_terminal, regexp_matches(text, '^[a-z0-9]') AS continues,
  regexp_matches(trim(text), {q(fixed.CONTENT_START)}) AS content_start, regexp_matches(trim(text), {q(fixed.FRONT_MATTER)}) AS front_matter,
  {abbr("text")} AS abbreviation FROM lines""")
SQL["word_predicates"] = with_(f"""
SELECT doc_id, count(*) AS words, count(*) FILTER (length(trim(w)) <= 4 AND regexp_matches(trim(w), '(?i)^[0-9ivxlcdm]+$')) AS page_numbers,
  count(*) FILTER ({abbr("w")}) AS abbreviations, count(*) FILTER (regexp_matches(trim(w), '^[A-Z]$')) AS capitals
FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM lines) GROUP BY doc_id""")
CTE["broken"] = """
  SELECT doc_id, para_idx, regexp_replace(regexp_replace(regexp_replace(text, '([a-z]{4})([a-z]{3})', '\\1- \\2', 'g'),
    ' (the|les|der|el) ', ' con dence rst ', 'g'), ' (and|et|und|y) ', ' dif cult (scienti c) \\1- or ', 'g') AS text FROM lines"""
CTE["hyphened"] = f"SELECT doc_id, para_idx, {hyphens('text')} AS text FROM broken"
ligatures("lig_broken", "broken", "doc_id, para_idx", "text")
ligatures("lig_hyphened", "hyphened", "doc_id, para_idx", "text")
SQL["repair_hyphenation"] = with_("SELECT doc_id, para_idx, text FROM hyphened")
SQL["repair_ligatures"] = with_("SELECT doc_id, para_idx, text FROM lig_broken")
SQL["repair_text"] = with_("SELECT doc_id, para_idx, text FROM lig_hyphened")
CTE["doc_hyphened"] = f"SELECT doc_id, {hyphens('text')} AS text FROM documents"
ligatures("doc_lig", "doc_hyphened", "doc_id", "text")
CTE["doc_clean"] = f"SELECT doc_id, {strip('text')} AS text FROM doc_lig"
SQL["clean_for_speech"] = with_("SELECT doc_id, text FROM doc_clean")
CTE["marked_up"] = r"""
  SELECT doc_id, para_idx, replace(replace(text, '. ', '.``` x' || chr(10) || 'y``` \(a\) \[b\] '), ', ', ' $q$ ─━ -' || chr(10)) AS text FROM lines"""
SQL["strip_markup"] = with_(f"SELECT doc_id, para_idx, {strip('text')} AS text FROM marked_up")
SQL["word_functions"] = with_("""
SELECT doc_id, para_idx, len(regexp_split_to_array(trim(text), '\\s+'))::INTEGER AS words,
  CASE WHEN pos <= 0 THEN 0 ELSE greatest(0, least(len(ws) - 1, len(list_filter(ends, lambda e: e <= pos)))) END::INTEGER AS word_at,
  CASE WHEN para_idx % 12 < len(ws) THEN ends[para_idx % 12 + 1] - length(ws[para_idx % 12 + 1]) ELSE 0 END::INTEGER AS char_of,
  len(regexp_extract_all(text, '\\S+|\\s+'))::INTEGER AS pieces
FROM (SELECT *, para_idx * 7 + length(text) % 90 AS pos, regexp_extract_all(text, '\\S+') AS ws,
  list_reduce(list_transform(regexp_extract_all(text, '\\s*\\S+'), lambda t: {'z': length(t), 'o': []::BIGINT[]}),
    lambda a, t: {'z': a.z + t.z, 'o': list_append(a.o, a.z + t.z)}, {'z': 0::BIGINT, 'o': []::BIGINT[]}).o AS ends FROM lines)""")
SQL["label_functions"] = """
SELECT doc_id, CAST(abs(list_reduce(list_transform(string_split(text, ''), lambda c: ord(c)::BIGINT),
    lambda h, u: ((h * 31 + u + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT)) % 360 AS INTEGER) AS hue,
  coalesce(nullif(upper(left(trim(text), 1)), ''), '?') AS initial,
  CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS time,
  CASE WHEN m < 60 THEN CAST(floor(m + 0.5) AS BIGINT) || 's' WHEN mm < 60 THEN mm || 'm' ELSE (mm // 60) || 'h ' || (mm % 60) || 'm' END AS mins,
  CAST(greatest(n_chars % 40 - 1, 0) AS BIGINT) AS chapter, source AS voice, CASE WHEN doc_id % 3 = 0 THEN 'Untitled' ELSE source END AS title,
  lang = 'en' AS english, left(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 200) AS heading
FROM (SELECT *, CAST(floor(n_chars / 3.0) AS BIGINT) AS s, n_chars / 7.0::DOUBLE AS m, CAST(floor(n_chars / 7.0::DOUBLE / 60 + 0.5) AS BIGINT) AS mm FROM documents)"""
SQL["measure_functions"] = with_("""
SELECT doc_id, para_idx, round(greatest(0.4, n / 14), 6) AS est_sec, round(CASE WHEN rate > 0 THEN x / (14 * rate) ELSE 0 END, 6) AS position_sec,
  round(CASE WHEN rate > 0 THEN n / (14 * rate) ELSE 0 END, 6) AS duration_sec, CAST(greatest(0, least(n, floor(x / 4 * 14 * rate + 0.5))) AS BIGINT) AS seek_char,
  round(greatest(0.1, least(10, x - 3)), 6) AS rate, round(CASE WHEN para_idx % 7 > 0 THEN greatest(0, least(100, x / (para_idx % 7) * 100)) ELSE 0 END, 6) AS pct,
  round(floor(x / 3 * 2 + 0.5) / 2, 6) AS size, round(72 + CASE WHEN para_idx % 2 = 0 AND para_idx <> 0 THEN x ELSE n * 11 * 0.5 END, 6) AS run_end
FROM (SELECT doc_id, para_idx, para_idx::DOUBLE AS x, length(text)::DOUBLE AS n, (para_idx % 4 * 0.5)::DOUBLE AS rate FROM lines)""")

# --- layout ----------------------------------------------------------------------------------

SQL["group_lines"] = with_("SELECT doc_id, page, line, min(run_idx) AS first_run, count(*) AS runs FROM lined GROUP BY doc_id, page, line")
SQL["join_runs"] = with_("SELECT doc_id, page, line, round(y, 6) AS y, text, font_size FROM text_lines")
SQL["dominant_font_size"] = with_("SELECT doc_id, page, line, font_size FROM line_sizes")
SQL["lines_to_paragraphs"] = with_("SELECT doc_id, page, seq, text, font_size FROM raw_paras")
CTE["tiny_paras"] = """
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, w) - 1 AS idx,
    CASE WHEN length(str) = 2 AND regexp_matches(str, '^[A-Za-z]') THEN upper(left(str, 1)) ELSE str END AS text FROM words"""
CTE["cap_fold"] = """
  SELECT doc_id, ts, list_reduce(list_transform(ts, lambda t: {'a': t, 'b': '', 'c': '', 'o': []::INTEGER[]}),
    lambda s, t: CASE WHEN regexp_matches(t.a, '^[A-Z]$') THEN {'a': t.a, 'b': s.a, 'c': s.b, 'o': list_append(s.o, 0)}
      WHEN NOT regexp_matches(t.a, '^[a-z]') THEN {'a': '', 'b': s.a, 'c': s.b, 'o': list_append(s.o, 0)}
      WHEN s.a <> '' THEN {'a': '', 'b': '', 'c': s.b, 'o': list_append(s.o, 1)}
      WHEN s.b <> '' THEN {'a': '', 'b': '', 'c': '', 'o': list_append(s.o, 2)}
      WHEN s.c <> '' THEN {'a': '', 'b': s.a, 'c': s.b, 'o': list_append(s.o, 3)}
      ELSE {'a': '', 'b': s.a, 'c': s.b, 'o': list_append(s.o, 0)} END,
    {'a': '', 'b': '', 'c': '', 'o': []::INTEGER[]}) AS f FROM (SELECT doc_id, list(text ORDER BY idx) AS ts FROM tiny_paras GROUP BY doc_id)"""
CTE["cap_rows"] = "SELECT doc_id, unnest(range(0, len(ts))) AS idx, unnest(ts) AS text, unnest(f.o) AS takes FROM cap_fold"
SQL["merge_drop_caps"] = with_("""
SELECT r.doc_id, r.idx, coalesce(c.text, '') || r.text AS text FROM cap_rows r LEFT JOIN cap_rows c ON r.takes > 0 AND c.doc_id = r.doc_id AND c.idx = r.idx - r.takes
WHERE NOT EXISTS (SELECT 1 FROM cap_rows t WHERE t.takes > 0 AND t.doc_id = r.doc_id AND t.idx - t.takes = r.idx)""")
SQL["drop_chrome"] = with_("SELECT doc_id, para_idx, page, text FROM chromeless")
SQL["to_paragraphs"] = with_("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS para_idx, page, text, font_size FROM chromeless")

# --- sections --------------------------------------------------------------------------------

SQL["weighted_median_size"] = with_("SELECT doc_id, median_size, weight_total FROM book_median")
SQL["pick_headings"] = with_("""
SELECT doc_id, para_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx - r ORDER BY para_idx) AS k FROM (
  SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS r FROM lines WHERE length(left(trim(text), 200)) < 80)) WHERE k % 2 = 1""")
_ROWS = "SELECT doc_id, chapter_idx, chapter_id, title, start_page, detection_mode, paragraphs FROM "
SQL["sections_from_headings"] = with_(_ROWS + "plain_chapters")
SQL["sections_from_outline"] = with_(_ROWS + "toc_chapters")
SQL["sections_by_word_count"] = with_(_ROWS + "bits_chapters")
SQL["choose_sections"] = with_(_ROWS + "book_chapters")
CTE["page_members"] = "SELECT doc_id, para_idx, CAST(page AS BIGINT) AS key FROM lines"
joined("paged", "lines", "page_members")
SQL["join_blocks"] = with_("SELECT doc_id, key AS chapter_key, text FROM paged_text")
SQL["renumber_chapters"] = with_("""
SELECT doc_id, row_number() OVER w - 1 AS chapter_idx, para_idx AS chapter_key, 'ch_' || row_number() OVER w AS chapter_id, text AS title, page AS start_page,
  'heading' AS detection_mode FROM web WHERE font_size > 11 WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx)""")
SQL["build_chapters"] = with_("SELECT * FROM run_sentences")
SQL["build_web_chapters"] = with_("SELECT * FROM book_sentences")
SQL["book_content"] = with_("""
SELECT c.doc_id, c.chapter_idx, c.chapter_id, c.title, c.start_page, c.detection_mode, count(s.text) AS sentences,
  coalesce(string_agg(s.text, chr(10) ORDER BY s.sentence_idx), '') AS text
FROM book_chapters c LEFT JOIN book_sentences s ON s.doc_id = c.doc_id AND s.chapter_idx = c.chapter_idx GROUP BY ALL""")
SQL["build_chapters_unicode"] = with_("SELECT * FROM unibook_sentences")
sentence_rows("mixed", None, "text", "SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en'")
SQL["build_mixed_language_chapters"] = with_("SELECT * FROM mixed_sentences")
SQL["narration_chapters"] = with_("""
SELECT c.doc_id, c.chapter_idx, c.chapter_id, c.title, c.start_page, c.detection_mode, count(s.text) AS sentence_count,
  round(coalesce(sum(greatest(0.4, length(s.text) / 14::DOUBLE)), 0), 6) AS est_seconds
FROM text_chapters c LEFT JOIN text_sentences s ON s.doc_id = c.doc_id AND s.chapter_idx = c.chapter_idx
GROUP BY ALL""")

# --- sentences -------------------------------------------------------------------------------

CTE["turns"] = "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations"
simple_split("turn_split", "turns", "conv_id, turn", "text")
capped("turn_cap", "turns", "conv_id, turn")
unicode_split("turn_seg", "turns", "conv_id, turn", "text", merge=False)
SQL["segment_sentences"] = with_("SELECT conv_id, turn, pos, text FROM turn_seg")
CTE["foreign_pieces"] = f"""
  SELECT conv_id, turn, i, p, sum(begins) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM (
    SELECT conv_id, turn, i, p, CASE WHEN i > 0 AND regexp_matches(p, '^[。！؟,:;\\-–—]') THEN 0 ELSE 1 END AS begins FROM (
      SELECT conv_id, turn, unnest(range(0, len(ps))) AS i, unnest(ps) AS p FROM (
        SELECT conv_id, turn, string_split(regexp_replace(translate(text, '.!?', '。！؟'), {q('([。！؟]+' + CLOSERS + '* *)')}, '\\1' || {MARK}, 'g'), {MARK}) AS ps FROM turns)))"""
CTE["foreign_groups"] = "SELECT conv_id, turn, g, trim(string_agg(p, '' ORDER BY i)) AS text FROM foreign_pieces GROUP BY conv_id, turn, g"
SQL["segment_other_scripts"] = with_("""
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY g) - 1 AS INTEGER) AS pos, text FROM foreign_groups WHERE text <> ''""")
SQL["split_sentences_simple"] = with_("SELECT conv_id, turn, pos, text FROM turn_split")
SQL["enforce_max_length"] = with_("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY part) - 1 AS INTEGER) AS pos, text FROM turn_cap")
CTE["short_pieces"] = """
  SELECT conv_id, turn, unnest(range(0, len(ps))) AS i, unnest(ps) AS p FROM (SELECT conv_id, turn,
    string_split(replace(regexp_replace(text, '([a-z]) ([a-z]) ', '\\1 \\2. ', 'g'), '. ', '.' || chr(64976)), chr(64976)) AS ps FROM turns)"""
CTE["short_groups"] = f"""
  SELECT conv_id, turn, i, p, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM (
    SELECT conv_id, turn, i, p, CASE WHEN {abbr("lag(p) OVER w")} THEN 0 ELSE 1 END AS starts
    FROM (SELECT conv_id, turn, i, trim(p) AS p FROM short_pieces WHERE trim(p) <> '') WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))"""
SQL["merge_abbreviations"] = with_("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY g) - 1 AS INTEGER) AS pos, string_agg(p, ' ' ORDER BY i) AS text FROM short_groups GROUP BY conv_id, turn, g")
simple_split("doc_split", "doc_clean", "doc_id", "text")
capped("doc_cap", "doc_split", "doc_id, pos")
SQL["split_sentences"] = with_("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS INTEGER) AS pos, text FROM doc_cap")
unicode_split("doc_uni", "doc_clean", "doc_id", "text")
capped("doc_unicap", "doc_uni", "doc_id, pos")
SQL["split_sentences_unicode"] = with_("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS INTEGER) AS pos, text FROM doc_unicap")
SQL["explode_sentences"] = with_("""
SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn AS chapter_idx, 'ch_' || (turn + 1) AS chapter_id, CAST(pos AS BIGINT) AS sentence_idx,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS global_idx, text FROM turn_split""")
SQL["explode_words"] = with_("""
SELECT doc_id, global_idx, CAST(count(*) FILTER (is_word) OVER w - 1 AS INTEGER) AS word_idx, CAST(sum(length(t)) OVER w - length(t) AS INTEGER) AS char_index, t AS word
FROM (SELECT doc_id, global_idx, i, ts[i] AS t, regexp_matches(ts[i], '^\\S') AS is_word FROM (
  SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, global_idx, regexp_extract_all(text, '\\S+|\\s+') AS ts FROM spoken)))
WINDOW w AS (PARTITION BY doc_id, global_idx ORDER BY i ROWS UNBOUNDED PRECEDING) QUALIFY is_word""")

# --- catalog and reports ---------------------------------------------------------------------

SQL["book_counts"] = with_("SELECT doc_id, count(DISTINCT chapter_idx) AS chapter_count, 'wordSplit' AS detection_mode, count(*) AS sentence_count FROM spoken GROUP BY doc_id")
CTE["chapter_sec"] = "SELECT doc_id, chapter_idx, sum(greatest(0.4, length(text) / 14::DOUBLE)) AS s FROM spoken GROUP BY ALL"
SQL["chapter_seconds"] = with_("SELECT doc_id, chapter_idx, round(s, 6) AS est_seconds FROM chapter_sec")
SQL["book_duration"] = with_("SELECT doc_id, round(sum(s), 6) AS est_seconds FROM chapter_sec GROUP BY doc_id")
SQL["books_with_progress"] = with_("SELECT s.book_id, title, chapter_id, sentence_idx, offset_sec, char_index FROM shelf s LEFT JOIN last_saved l ON l.book_id = s.book_id")
SQL["books_with_content"] = with_("""
SELECT book_id, n AS sentences, later AS later_sentences FROM shelf
LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (chapter_idx > 0) AS later FROM spoken GROUP BY doc_id) USING (doc_id)""")
SQL["place_progress"] = with_("""
SELECT event_id, book_id, coalesce(global_idx, 0) AS global_idx FROM saved LEFT JOIN (SELECT doc_id, chapter_id, sentence_idx, global_idx FROM spoken) USING (doc_id, chapter_id, sentence_idx)""")
CTE["overview"] = """
  SELECT s.*, coalesce(CAST(substr(chapter_id, 4) AS BIGINT) - 1, 0) AS chapter_idx,
    greatest(0, least(100, coalesce(CAST(substr(chapter_id, 4) AS BIGINT) - 1, 0) / chapter_count::DOUBLE * 100)) AS pct
  FROM shelf s LEFT JOIN last_saved l ON l.book_id = s.book_id"""
SQL["library_overview"] = with_("SELECT book_id, title, chapter_idx, round(pct, 6) AS progress_pct FROM overview ORDER BY added_at DESC, doc_id")
SQL["continue_reading"] = with_("""
SELECT owner, book_id, round(pct, 6) AS progress_pct FROM (SELECT *, string_split(file_name, '_')[1] AS owner FROM overview WHERE pct > 0 AND pct < 99)
QUALIFY row_number() OVER (PARTITION BY owner ORDER BY added_at DESC, doc_id) = 1""")


def first_content(src: str, title: str) -> str:
    return f"""
      SELECT doc_id, coalesce(min_by(g, r * 1000000 + chapter_idx) FILTER (r IS NOT NULL), 0)::BIGINT AS global_idx FROM (
        SELECT doc_id, chapter_idx, g, CASE WHEN n < 5 THEN NULL WHEN regexp_matches(t, {q(fixed.CONTENT_START)}) THEN 1
          WHEN NOT regexp_matches(t, {q(fixed.FRONT_MATTER)}) THEN 2 END AS r
        FROM (SELECT doc_id, chapter_idx, count(*) AS n, min(global_idx) AS g, trim(max({title}) FILTER (sentence_idx = 0)) AS t FROM {src} GROUP BY ALL))
      GROUP BY doc_id"""


CTE["web_spoken"] = "SELECT doc_id, para_idx // 7 AS chapter_idx, para_idx % 7 AS sentence_idx, para_idx AS global_idx, text FROM web"
SQL["first_content_sentence"] = with_(first_content(
    "web_spoken", "CASE WHEN global_idx % 3 = 0 THEN 'Contents ' WHEN global_idx % 5 = 0 THEN 'Chapter ' ELSE '' END || text"))
SQL["preferred_voice"] = """
SELECT CAST(c_nationkey AS VARCHAR) AS device_id, 'v' || c_custkey AS voice_id FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 4 = 0 OR c_custkey % 9 = 0 THEN 0 ELSE 1 END,
  CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 13 = 0 THEN 3 WHEN c_custkey % 7 = 0 THEN 4 WHEN c_custkey % 5 = 0 THEN 6
    WHEN c_custkey % 10 = 0 THEN 7 ELSE 8 END, c_custkey) = 1"""
CTE["checked"] = """
  SELECT doc_id, global_idx, text, regexp_matches(trim(text), '^[a-z]')::INT AS lowercase_start,
    len(regexp_extract_all(text, '\\b\\w+- \\w+\\b')) + (regexp_matches(text, '\\w-$') AND coalesce(regexp_matches(lead(text) OVER w, '^\\w'), false))::INT AS broken_hyphen,
    (regexp_matches(trim(text), '^[A-Z]\\s') AND length(trim(text)) < 60)::INT AS orphan_capital, (length(trim(text)) <= 3)::INT AS tiny,
    (length(text) > 400)::INT AS over_cap, len(regexp_extract_all(text, ' {2,}')) AS double_blank
  FROM spoken WINDOW w AS (PARTITION BY doc_id ORDER BY global_idx)"""
_CHECKS = ["lowercase_start", "broken_hyphen", "orphan_capital", "tiny", "over_cap", "double_blank"]
SQL["sentence_audit"] = with_("SELECT doc_id, count(*) AS sentences, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _CHECKS) + " FROM checked GROUP BY doc_id")
CTE["hits"] = " UNION ALL ".join(f"SELECT '{c}' AS check_name, {c} AS n, doc_id, global_idx, text FROM checked WHERE {c} > 0" for c in _CHECKS)
CTE["ranked"] = "SELECT *, CAST(row_number() OVER (PARTITION BY check_name ORDER BY doc_id, global_idx) AS INTEGER) AS rank FROM hits"
SQL["audit_examples"] = with_("SELECT check_name, rank, doc_id, global_idx, left(text, 60) AS example FROM ranked WHERE rank <= 6")
SQL["corpus_audit"] = with_("SELECT check_name, coalesce(n, 0)::BIGINT AS n, coalesce(examples, '') AS examples FROM (SELECT unnest(["
    + ", ".join(q(c) for c in _CHECKS) + "]) AS check_name) LEFT JOIN (SELECT check_name, sum(n) AS n, string_agg(left(text, 60), '|' ORDER BY rank) FILTER (rank <= 4) AS examples FROM ranked GROUP BY check_name) USING (check_name)")
CTE["whole"] = """
  SELECT doc_id, string_agg(text, ' ' ORDER BY global_idx) AS s, string_agg(text, ' ' ORDER BY global_idx) FILTER (global_idx < 5) AS run,
    string_agg(text, ' ' ORDER BY global_idx) FILTER (global_idx IN (0, 2)) AS gap FROM spoken GROUP BY doc_id"""
CTE["needles"] = "SELECT doc_id AS case_id, s, unnest([run, 'and', gap, ', the']) AS needle, unnest([true, true, false, false]) AS wanted FROM whole"
CTE["found"] = "SELECT case_id, needle, wanted, contains(s, needle) AS found FROM needles"
SQL["integrity_checks"] = with_("SELECT case_id, bool_and(found = wanted) AS passed, count(*) FILTER (found <> wanted) AS failures FROM (SELECT DISTINCT * FROM found) GROUP BY case_id")
SQL["punctuation_checks"] = with_("SELECT doc_id, bool_or(contains(text, '..')) AS doubled_period, bool_or(contains(text, ' .')) AS blank_before_period FROM spoken GROUP BY doc_id")
CTE["placed_runs"] = "SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY run_idx) - 1 AS pos FROM word_runs"
CTE["run_hits"] = """
  SELECT doc_id, page, pos, match FROM (
    SELECT doc_id, page, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS INTEGER) AS match FROM placed_runs WHERE contains(text, 'tion'))
  WHERE match <= 3"""
CTE["run_places"] = " UNION ALL ".join(f"SELECT doc_id, page, match, pos AS hit_pos, pos + ({k}) AS pos FROM run_hits" for k in range(-3, 4))
SQL["runs_in_context"] = with_("""
SELECT r.doc_id, h.match, r.page, CAST(r.pos AS INTEGER) AS pos, r.pos = h.hit_pos AS is_match, r.text, r.x
FROM run_places h JOIN placed_runs r ON r.doc_id = h.doc_id AND r.page = h.page AND r.pos = h.pos""").replace(RECURSIVE, "WITH ", 1)
SQL["detection_mode_summary"] = with_("""
SELECT detection_mode, count(DISTINCT c.doc_id) AS documents, count(*) AS chapters, sum(coalesce(n, 0))::BIGINT AS sentences FROM book_chapters c
LEFT JOIN (SELECT doc_id, chapter_idx, count(*) AS n FROM book_sentences GROUP BY ALL) s ON s.doc_id = c.doc_id AND s.chapter_idx = c.chapter_idx GROUP BY detection_mode""")
SQL["font_size_profile"] = with_("""
SELECT w.doc_id, w.font_size, paragraphs, w.w AS weight, median_size, median_size * 1.25 AS threshold, w.font_size >= median_size * 1.25 AS is_heading_size
FROM book_weights w JOIN book_median m ON m.doc_id = w.doc_id JOIN (SELECT doc_id, font_size, count(*) AS paragraphs FROM web GROUP BY ALL) n
ON n.doc_id = w.doc_id AND n.font_size = w.font_size""")

# --- navigation ------------------------------------------------------------------------------

SQL["chapter_starts"] = with_("""
SELECT doc_id, chapter_idx, round(s, 6) AS est_seconds, round(coalesce(sum(s) OVER (PARTITION BY doc_id ORDER BY chapter_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start_sec FROM chapter_sec""")
SQL["chapter_position"] = with_("""
SELECT doc_id, chapter_idx, sentence_idx, round(c + p, 6) AS chapter_pos_sec, round(b + p, 6) AS book_pos_sec FROM (
  SELECT *, round(length(text) / 28::DOUBLE, 6) AS p, coalesce(sum(sec) OVER (PARTITION BY doc_id, chapter_idx ORDER BY global_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
    coalesce(sum(sec) OVER (PARTITION BY doc_id ORDER BY global_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM (SELECT *, greatest(0.4, length(text) / 14::DOUBLE) AS sec FROM spoken))""")
CTE["begins"] = "SELECT doc_id, chapter_idx, min(global_idx) AS g FROM spoken GROUP BY ALL"
SQL["neighbour_targets"] = with_("""
SELECT s.doc_id, s.chapter_idx, s.sentence_idx, s.global_idx, greatest(0, s.global_idx - 1) AS prev_sentence,
  lead(s.global_idx) OVER (PARTITION BY s.doc_id ORDER BY s.global_idx) AS next_sentence,
  CASE WHEN s.global_idx > c.g THEN c.g ELSE p.g END AS prev_chapter, n.g AS next_chapter
FROM spoken s JOIN begins c ON c.doc_id = s.doc_id AND c.chapter_idx = s.chapter_idx
LEFT JOIN begins p ON p.doc_id = s.doc_id AND p.chapter_idx = s.chapter_idx - 1 LEFT JOIN begins n ON n.doc_id = s.doc_id AND n.chapter_idx = s.chapter_idx + 1""")
CTE["asks"] = """
  SELECT event_id, json_extract_string(props, '$.k') AS doc_id, event_id % 9 AS global_idx, CAST(floor(value) AS BIGINT) AS char_index,
    (0.5 + event_id % 4 * 0.5)::DOUBLE AS rate, ((event_id % 13 - 6) * 4.0)::DOUBLE AS delta FROM events"""
CTE["text_spans"] = """
  SELECT doc_id, global_idx, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY global_idx) AS e,
    max(global_idx) OVER (PARTITION BY doc_id) AS last, sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM spoken"""
CTE["skips"] = """
  SELECT a.event_id, a.doc_id, s.global_idx, n, e, last, total, char_index + CAST(floor(delta * 14 * rate + 0.5) AS BIGINT) AS pos
  FROM asks a JOIN text_spans s ON s.doc_id = a.doc_id AND s.global_idx = a.global_idx"""
SQL["skip_seconds"] = with_("""
SELECT k.event_id, CASE WHEN pos BETWEEN 0 AND k.n THEN k.global_idx WHEN k.e - k.n + pos < 0 THEN 0 WHEN k.e - k.n + pos > k.total THEN k.last ELSE t.global_idx END::BIGINT AS to_global_idx,
  CASE WHEN pos BETWEEN 0 AND k.n THEN pos WHEN k.e - k.n + pos < 0 THEN 0 WHEN k.e - k.n + pos > k.total THEN z.n ELSE k.e - k.n + pos - (t.e - t.n) END::BIGINT AS to_char_index
FROM skips k LEFT JOIN text_spans t ON t.doc_id = k.doc_id AND ((pos > k.n AND k.e - k.n + pos > t.e - t.n AND k.e - k.n + pos <= t.e)
  OR (pos < 0 AND k.e - k.n + pos >= t.e - t.n AND k.e - k.n + pos < t.e))
JOIN text_spans z ON z.doc_id = k.doc_id AND z.global_idx = k.last""")
CTE["opening"] = first_content("spoken", "text")
SQL["resolve_resume"] = with_("""
SELECT book_id, global_idx, CASE WHEN char_index > 0 THEN greatest(0, least(length(text), char_index)) WHEN offset_sec <> 0
  THEN greatest(0, least(length(text), floor(offset_sec * 14 + 0.5))) ELSE 0 END::BIGINT AS char_index
FROM (SELECT b.book_id, b.doc_id, l.char_index, l.offset_sec, coalesce(CASE WHEN l.book_id IS NOT NULL THEN s.global_idx ELSE o.global_idx END, 0) AS global_idx
  FROM shelf b LEFT JOIN last_saved l ON l.book_id = b.book_id LEFT JOIN spoken s ON s.doc_id = b.doc_id AND s.chapter_id = l.chapter_id AND s.sentence_idx = l.sentence_idx
  LEFT JOIN opening o ON o.doc_id = b.doc_id) LEFT JOIN spoken USING (doc_id, global_idx)""")
SQL["seek_target"] = with_("""
SELECT event_id, global_idx, CASE WHEN w > 0 AND w < len(ws) THEN length(array_to_string(ws[1:w], '')) + length(regexp_extract(ws[w + 1], '^\\s*')) ELSE 0 END::BIGINT AS char_index
FROM (SELECT event_id, s.global_idx, event_id % 6 AS w, regexp_extract_all(text, '\\s*\\S+') AS ws FROM asks a JOIN spoken s ON s.doc_id = a.doc_id AND s.global_idx = a.global_idx)""")
SQL["advance_sequence"] = with_("""
SELECT event_id, CASE WHEN rest <> '' THEN a.global_idx ELSE n.global_idx END AS speak_idx, CASE WHEN rest <> '' THEN char_index WHEN n.global_idx IS NOT NULL THEN 0 END AS speak_from
FROM (SELECT a.*, trim(substr(text, char_index + 1)) AS rest FROM asks a JOIN spoken s ON s.doc_id = a.doc_id AND s.global_idx = a.global_idx) a
LEFT JOIN spoken n ON n.doc_id = a.doc_id AND n.global_idx = a.global_idx + 1""")

# --- playback --------------------------------------------------------------------------------

_DELAY = 2 * 24 * 3600 * 1000
CTE["updates"] = """
  SELECT user_id AS reader_id, event_id, epoch_us(ts) // 1000 AS ms, event_type = 'signup' AND event_id % 4 = 0 AS closes, value FROM events"""
CTE["update_fold"] = f"""
  SELECT reader_id, es, list_reduce(list_transform(es, lambda e: {{'a': e.ms, 'c': e.closes, 'w': 0, 'o': []::INTEGER[]}}),
    lambda s, e: CASE WHEN e.c THEN {{'a': NULL, 'c': true, 'w': s.w, 'o': list_append(s.o, -1)}}
      WHEN s.a IS NULL OR e.a >= s.a + {_DELAY} THEN {{'a': e.a, 'c': false, 'w': s.w + 1, 'o': list_append(s.o, s.w + 1)}}
      ELSE {{'a': s.a, 'c': false, 'w': s.w, 'o': list_append(s.o, s.w)}} END,
    {{'a': NULL::BIGINT, 'c': false, 'w': 0, 'o': []::INTEGER[]}}) AS f
  FROM (SELECT reader_id, list({{'ms': ms, 'event_id': event_id, 'closes': closes, 'value': value}} ORDER BY ms, event_id) AS es FROM updates GROUP BY reader_id)"""
CTE["update_rows"] = "SELECT reader_id, unnest(es, recursive := true), unnest(f.o) AS w FROM update_fold"
CTE["update_waits"] = """
  SELECT reader_id, w, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS updates, arg_max(event_id, ms * 1000000 + event_id) AS event_id, arg_max(value, ms * 1000000 + event_id) AS value
  FROM update_rows WHERE w > 0 GROUP BY reader_id, w"""
CTE["saves"] = f"""
SELECT reader_id, CAST(coalesce(least(first_ms + {_DELAY}, (SELECT min(ms) FROM update_rows c WHERE c.reader_id = u.reader_id AND c.closes AND c.ms >= u.last_ms)), first_ms + {_DELAY}) AS BIGINT) AS fired_at_ms,
  updates, event_id, value FROM update_waits u"""
SQL["coalesce_updates"] = with_("SELECT * FROM saves")
SQL["coalesce_updates_stream"] = with_("SELECT * FROM saves")
CTE["played"] = """
  SELECT event_id, user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS book_id, epoch_us(ts) // 1000 AS ms,
    CASE event_type WHEN 'signup' THEN 'play' WHEN 'error' THEN 'pause' ELSE 'boundary' END AS kind, CAST(floor(value) AS BIGINT) AS position FROM events"""
SQL["monotonic_position"] = with_("SELECT event_id, max(position) OVER (PARTITION BY session_id, book_id ORDER BY ms, event_id) AS position FROM played")
SQL["furthest_position"] = with_("SELECT session_id, book_id, max(position) AS position FROM played GROUP BY ALL")
CTE["speech"] = """
  SELECT event_id, user_id AS session_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'boundary' ELSE 'tick' END AS kind,
    CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(floor(value) AS BIGINT) END AS c FROM events"""
CTE["utterances"] = """
  SELECT *, count(*) FILTER (kind = 'start') OVER (PARTITION BY session_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS utterance FROM speech"""
CTE["speech_anchor"] = """
  SELECT *, last_value(c IGNORE NULLS) OVER w AS a, last_value(CASE WHEN c IS NOT NULL THEN ms END IGNORE NULLS) OVER w AS since, bool_or(kind = 'boundary') OVER w AS seen
  FROM utterances WHERE utterance > 0 WINDOW w AS (PARTITION BY session_id, utterance ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)"""
SQL["interpolate_position"] = with_("""
SELECT event_id, position FROM (SELECT event_id, kind, max(p) OVER (PARTITION BY session_id, utterance ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS position FROM (
  SELECT *, CASE WHEN kind <> 'tick' THEN c ELSE CAST(floor(least(a + (ms - since) / 1000::DOUBLE * 14 * 0.001::DOUBLE, CASE WHEN seen THEN a + 90 ELSE 300 END, 300) + 0.5) AS BIGINT) END AS p
  FROM speech_anchor)) WHERE kind = 'tick'""")
CTE["late_utterances"] = """
  SELECT *, count(*) FILTER (kind = 'start' OR silent) OVER (PARTITION BY session_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS utterance
  FROM (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms, event_id) > 21600000, false) AS silent FROM speech)"""
CTE["late_anchor"] = """
  SELECT *, last_value(c IGNORE NULLS) OVER w AS a, last_value(CASE WHEN c IS NOT NULL THEN ms END IGNORE NULLS) OVER w AS since, bool_or(kind = 'boundary') OVER w AS seen
  FROM (SELECT * FROM late_utterances QUALIFY first_value(kind) OVER (PARTITION BY session_id, utterance ORDER BY ms, event_id) = 'start')
  WINDOW w AS (PARTITION BY session_id, utterance ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)"""
SQL["interpolate_position_late"] = SQL["interpolate_position_stream"] = with_("""
SELECT event_id, position FROM (SELECT event_id, kind, max(p) OVER (PARTITION BY session_id, utterance ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS position FROM (
  SELECT *, CASE WHEN kind <> 'tick' THEN c ELSE CAST(floor(least(a + (ms - since) / 1000::DOUBLE * 14 * 0.001::DOUBLE, CASE WHEN seen THEN a + 90 ELSE 300 END, 300) + 0.5) AS BIGINT) END AS p
  FROM late_anchor)) WHERE kind = 'tick'""")
SQL["monotonic_position_stream"] = SQL["monotonic_position"]
CTE["session_rows"] = """
  SELECT *, lag(ms) OVER w AS pms, lag(on_now) OVER w AS was_on FROM (
    SELECT *, coalesce(last_value(CASE kind WHEN 'play' THEN true WHEN 'pause' THEN false END IGNORE NULLS) OVER (PARTITION BY session_id, spell ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING), false) AS on_now
    FROM (SELECT *, count(*) FILTER (gap > 21600000) OVER (PARTITION BY session_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS spell
      FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms, event_id) AS gap FROM played)))
  WINDOW w AS (PARTITION BY session_id, spell ORDER BY ms, event_id)"""
SQL["playback_sessions"] = SQL["playback_sessions_stream"] = with_("""
SELECT session_id, min(ms) AS started_ms, max(ms) AS ended_ms, count(*) AS events, count(*) FILTER (kind = 'play') AS plays,
  round(sum(CASE WHEN was_on THEN ms - pms ELSE 0 END) / 1000::DOUBLE, 6) AS listened_sec, max(position) AS furthest FROM session_rows GROUP BY session_id, spell""")
CTE["gaps"] = """
  SELECT *, lag(ms) OVER w AS pms, lag(kind) OVER w AS pkind, bool_or(kind = 'boundary') OVER (PARTITION BY session_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM played WINDOW w AS (PARTITION BY session_id ORDER BY ms, event_id)"""
SQL["detect_stalls"] = with_("""
SELECT session_id, event_id, pms AS stalled_from_ms, ms - pms AS silence_ms FROM gaps WHERE pkind IN ('play', 'boundary') AND ms - pms > CASE WHEN seen THEN 28800000 ELSE 14400000 END""")
CTE["silences"] = """
  SELECT *, lead(ms) OVER w AS nms, CASE WHEN bool_or(kind = 'boundary') OVER (PARTITION BY session_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) THEN 28800000 ELSE 14400000 END AS quiet
    FROM played WINDOW w AS (PARTITION BY session_id ORDER BY ms, event_id)"""
SQL["detect_stalls_stream"] = with_("""
SELECT CAST(session_id AS VARCHAR) AS key, ms AS stalled_from_ms, CAST(quiet AS BIGINT) AS limit_ms FROM silences
WHERE kind IN ('play', 'boundary') AND (nms IS NULL OR nms - ms > quiet)""")
CTE["spells"] = """
  SELECT session_id, us, kind, position, sum(CASE WHEN us < pus + 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY us, event_id) AS n FROM (
    SELECT p.*, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pus FROM played p JOIN (SELECT event_id, ts FROM events) USING (event_id))"""
SQL["listening_sessions_stream"] = with_("""
SELECT session_id, min(us) // 1000 AS started_ms, count(*) AS events, count(*) FILTER (kind = 'play') AS plays, max(position) AS furthest FROM spells
GROUP BY session_id, n""")
CTE["playing"] = """
  SELECT *, lag(ms) OVER w AS pms, lag(on_now) OVER w AS was_on FROM (
    SELECT *, coalesce(last_value(CASE kind WHEN 'play' THEN true WHEN 'pause' THEN false END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING), false) AS on_now FROM played)
  WINDOW w AS (PARTITION BY session_id ORDER BY ms, event_id)"""
SQL["sessionize_playback"] = with_("""
SELECT session_id, count(*) FILTER (kind = 'play') AS plays, round(sum(CASE WHEN was_on THEN ms - pms ELSE 0 END) / 1000::DOUBLE, 6) AS listened_sec, max(position) AS furthest FROM playing GROUP BY session_id""")
CTE["arrived"] = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS para_idx, page, text, font_size FROM chromeless"
sections("arr", "arrived", None, 3000)
joined("arr", "arrived", "arr_members")
sentence_rows("arr")
SQL["incremental_chapters"] = with_("""
SELECT c.doc_id, c.chapter_idx, c.title, c.start_page, c.detection_mode, count(s.text) AS sentences, coalesce(sum(length(s.text)), 0)::BIGINT AS chars
FROM arr_chapters c LEFT JOIN arr_sentences s ON s.doc_id = c.doc_id AND s.chapter_idx = c.chapter_idx GROUP BY ALL""")
