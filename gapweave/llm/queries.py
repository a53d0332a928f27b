"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op1_ann
from .bpe import op6_bpe
from .chat_format import op2_chat_format
from .decontaminate import op10_decontaminate
from .html_extract import op7_html_extract
from .license_scan import LICENSES, op3_license_scan
from .quality import op4_quality
from .sharding import op8_sharding
from .simhash_dedup import op5_simhash
from .suffix_dedup import op9_suffix_dedup


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    ops = (op1_ann, op2_chat_format, op3_license_scan, op4_quality, op5_simhash, op6_bpe, op7_html_extract, op8_sharding, op9_suffix_dedup, op10_decontaminate)
    return {f.__name__: f for f in ops} | {"pipeline": _pipeline}


_SAID = "'\\### Assistant: </turn> ok'"
_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '### ', '\\h'), '</turn>', '\\t')"

OP2 = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('### ' || replace({_ESCAPED.format('role')}, ':', '\\c') || ': ' || {_ESCAPED.format('text')} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


def _op3() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in LICENSES.items())
    words = "regexp_extract_all(lower(coalesce({0}, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH t(license, body) AS (VALUES {templates}),
tw AS (SELECT license, {words.format('body')} AS w FROM t),
tl AS (SELECT license, s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i, array_to_string(w[i : i + 4], ' ') AS s FROM tw)),
tn AS (SELECT license, count(DISTINCT s) AS n, CAST(2 ** ceil(log2(count(*))) AS BIGINT) AS c FROM tl GROUP BY license),
ts AS (SELECT DISTINCT license, s FROM tl),
dw AS (SELECT doc_id, {words.format('text')} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
hits AS (SELECT doc_id, license, i, s, c, n FROM ds JOIN ts USING (s) JOIN tn USING (license)),
win AS (SELECT doc_id, license, k, count(DISTINCT s) / CAST(any_value(n) AS DOUBLE) AS share, min(i) AS first FROM (SELECT *, unnest([i // c, i // c - 1]) AS k FROM hits) WHERE k >= 0 GROUP BY doc_id, license, k)
SELECT doc_id, license, share AS containment, CAST(first AS BIGINT) AS first_word, CAST(n_windows AS BIGINT) AS n_windows
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, license) AS n_windows, row_number() OVER (PARTITION BY doc_id, license ORDER BY share DESC, k) AS r FROM win WHERE share >= 0.8) WHERE r = 1
"""


# texts as hex digits, two for a byte; a window of 100 bytes that stands earlier covers what is removed
OP9 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS later FROM (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS p FROM b))),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS new FROM w WHERE later),
r AS (SELECT doc_id, min(p) AS first, max(p) + 100 AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT b.doc_id, substr(h, 2 * coalesce(lag(stop) OVER o, 0) + 1, 2 * (first - coalesce(lag(stop) OVER o, 0))) AS piece, first FROM b JOIN r ON b.doc_id = r.doc_id WINDOW o AS (PARTITION BY b.doc_id ORDER BY first)),
x AS (SELECT doc_id, string_agg(piece, '' ORDER BY first) AS head FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS spans, sum(stop - first) AS removed, max(stop) AS last FROM r GROUP BY doc_id)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN x ON b.doc_id = x.doc_id LEFT JOIN n ON b.doc_id = n.doc_id
"""


def oracle_sql():
    return {"op2_chat_format": OP2, "op3_license_scan": _op3(), "op9_suffix_dedup": OP9}
