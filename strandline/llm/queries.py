"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from .decontamination import op7_decontamination
from .language_id import op5_language_id
from .license_scan import op2_license_scan
from .ngram_join import op1_ngram_jaccard_join
from .secrets_scan import op10_secret_scan
from .sentencepiece_bpe import op6_sentencepiece
from .sharding import op3_sharding
from .suffix_dedup import op4_suffix_dedup
from .tiff_media import op9_tiff_media
from .toxicity import op8_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_sharding": op3_sharding,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_tiff_media": op9_tiff_media,
    "op10_secret_scan": op10_secret_scan,
}
_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 90 * (len(x.s) + len(y.s) - c)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT k.b, r.c FROM r JOIN k ON k.a = r.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
}
