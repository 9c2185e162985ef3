"""SQL for DuckDB that says what queries of this subpackage return, where SQL can."""

from __future__ import annotations

from tessera.llm import pii

#: Where SQL can say what a query returns.
SQL: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 100 = 0),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op6_lm_scores": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
        one AS (SELECT c, count(*) AS n FROM t GROUP BY c),
        two AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
        three AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
        s AS (SELECT t.doc_id, CASE WHEN three.n >= 2 THEN ln(three.n / context.n) WHEN two.n >= 2 THEN ln(0.4 * two.n / word.n) ELSE ln(0.16 * one.n / (SELECT count(*) FROM t)) END AS s
              FROM t JOIN one ON one.c = t.c LEFT JOIN two ON two.b = t.b AND two.c = t.c LEFT JOIN three ON three.a = t.a AND three.b = t.b AND three.c = t.c
              LEFT JOIN two context ON context.b = t.a AND context.c = t.b LEFT JOIN one word ON word.c = t.b)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, (SELECT round(avg(s.s), 6) FROM s WHERE s.doc_id = d.doc_id) AS score FROM d""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        r AS (SELECT doc_id, i FROM s SEMI JOIN (SELECT run FROM s GROUP BY run HAVING count(*) > 1) USING (run)),
        c AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS j FROM r),
        k AS (SELECT d.doc_id, list(d.word ORDER BY d.j) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) d ANTI JOIN c USING (doc_id, j) GROUP BY d.doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(len(kept), 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
}

#: Patterns of personal data as RE2 reads them, and what confirms a match m.
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({DIGITS}[-i] AS INT) WHEN CAST({DIGITS}[-i] AS INT) > 4 THEN 2 * CAST({DIGITS}[-i] AS INT) - 9 ELSE 2 * CAST({DIGITS}[-i] AS INT) END)) % 10 = 0"
LETTERS = "replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4]"
MOD_97 = f"list_reduce(list_prepend(0, list_transform(string_split({LETTERS}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda r, v: CASE WHEN v > 9 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END) = 1"
RUN = "[A-Za-z0-9_-]{15,}"
#: Kind, pattern, and what holds of a match m; scores and words are the operator's.
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(p, '0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])'))) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", MOD_97),
    ("key", RUN, f"regexp_full_match(m, '{pii.KEY_FORMS}')"),
    ("secret", RUN, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"),
    ("ssn", "[0-9-]{11,}", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
)


def personal_data() -> str:
    """Each kind's matches with their offsets and what stands around them: the text split at the pattern gives the gaps."""
    parts = []
    for i, ((kind, pattern, holds), k) in enumerate(zip(PERSONAL, pii.KINDS, strict=True)):
        found = f"SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d"
        each = f"SELECT doc_id, t, ms[i] AS m, right(gs[i], {pii.NEAR}) AS before, left(coalesce(gs[i + 1], ''), {pii.NEAR}) AS after, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({found}))"
        around = f"substr(t, greatest(a - {pii.NEAR}, 0) + 1, least(a, {pii.NEAR})) || chr(10) || substr(t, a + length(m) + 1, {pii.NEAR})" if k.group else "before || chr(10) || after"
        says = lambda words: f"regexp_matches(lower({around}), '(^|[^a-z0-9])({words})([^a-z0-9]|$)')"  # noqa: B023, E731
        score = f"least(100, {k.score} + CASE WHEN {says(k.words)} THEN {pii.RAISED} ELSE 0 END) - CASE WHEN {says(pii.AGAINST)} THEN {pii.LOWERED} ELSE 0 END"
        least = "" if k.base else f" WHERE score >= {pii.LEAST}"
        parts.append(f"SELECT * FROM (SELECT doc_id, {i} AS k, '{kind}' AS kind, a, a + length(m) AS b, CAST({score} AS BIGINT) AS score FROM ({each}) WHERE {holds}){least}")
    n = ", ".join(f"count(k) FILTER (k = {i}) AS n_{kind}" for i, (kind, *_) in enumerate(PERSONAL[:4]))
    spans = lambda where: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a){where}, '')"
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, {n}, sha256({spans(' FILTER (k < 4)')}) AS base_sha256, {spans('')} AS spans, max(score) AS top_score FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"


SQL["op3_pii"] = personal_data()

#: Rounds of water filling that the statement has room for; each ends with a full source more, or for good.
ROUNDS = 12


def mixing_quotas() -> str:
    """Sources weigh 1, 2, 3, …; what a full one can't take is shared again, round by round; then a cut in seeded order."""
    parts = [
        r"d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS told FROM documents)",
        "s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM d GROUP BY source)",
        "q0 AS (SELECT *, true AS open, CAST(0 AS DOUBLE) AS target, CAST((SELECT sum(size) FROM s) AS DOUBLE) AS left_ FROM s)",
    ]
    for r in range(ROUNDS):
        parts.append(f"u{r} AS (SELECT *, left_ / (SELECT sum(weight) FROM q{r} WHERE open) AS unit FROM q{r})")
        parts.append(f"f{r} AS (SELECT *, open AND left_ > 0 AND weight * unit >= 3 * size AS whole FROM u{r})")
        parts.append(
            f"q{r + 1} AS (SELECT source, size, weight, open AND left_ > 0 AND (SELECT bool_or(whole) FROM f{r}) AND NOT whole AS open, CASE WHEN whole THEN CAST(3 * size AS DOUBLE) WHEN open AND left_ > 0 AND NOT (SELECT bool_or(whole) FROM f{r}) THEN weight * unit ELSE target END AS target, "
            f"CASE WHEN (SELECT bool_or(whole) FROM f{r}) THEN left_ - (SELECT sum(3 * size) FROM f{r} WHERE whole) ELSE 0 END AS left_ FROM f{r})"
        )
    parts += [
        f"t AS (SELECT source, size AS source_size, target, least(CAST(round_even(target, 0) AS BIGINT), 3 * size) AS flow FROM q{ROUNDS})",
        "h AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.flow // t.source_size ELSE 0 END AS whole, CASE WHEN t.source_size > 0 THEN t.flow % t.source_size ELSE 0 END AS rest, CAST('0x' || md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || d.size || ':' || told)[1:15] AS BIGINT) AS place FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)",
        "g AS (SELECT source, place, sum(size) AS s FROM h GROUP BY ALL)",
        "c AS (SELECT source, place, s, sum(s) OVER (PARTITION BY source ORDER BY place) - s AS before FROM g)",
    ]
    return f"WITH {', '.join(parts)} SELECT h.doc_id, CAST(h.size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN h.size = 0 THEN 0 ELSE h.size * (whole + CASE WHEN rest > 0 AND before + s / 2 <= rest THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM h JOIN c ON c.source IS NOT DISTINCT FROM h.source AND c.place = h.place"


SQL["op7_mixing"] = mixing_quotas()

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CUT_WORDS = "string_split(phrase, ' ')"
SQL["op11_collocations"] = rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex({FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    s AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
    f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS r(k) WHERE len(w) >= k) GROUP BY ALL),
    c AS MATERIALIZED (SELECT lang, k, phrase, f AS a FROM f WHERE k >= 2 AND f >= 100),
    x AS (SELECT c.*, j, array_to_string({CUT_WORDS}[1:j], ' ') AS head, array_to_string({CUT_WORDS}[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c),
    v AS (SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, s.n, x.j, CAST(1000 AS HUGEINT) * x.a * s.n // (CAST(l.f AS HUGEINT) * r.f) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.tail JOIN s ON s.lang = x.lang),
    low AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inner_ AS (SELECT lang, array_to_string({CUT_WORDS}[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) AS q(m) WHERE m < k) GROUP BY ALL),
    o AS (SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low ANTI JOIN (SELECT lang, phrase, most FROM inner_) i ON i.lang = low.lang AND i.phrase = low.phrase AND 100 * i.most >= 100 * low.a)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""

NORMAL_WORDS = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op12_decontamination"] = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {NORMAL_WORDS} AS w FROM documents),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {NORMAL_WORDS} AS w FROM benchmark),
    i AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
    r AS (SELECT row, i, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
    h AS MATERIALIZED (SELECT r.row, r.i, r.k, i.item FROM r JOIN i USING (k, run)),
    n AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + k)) AS j FROM h) GROUP BY row),
    t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)"""

#: Levels that the statement has room for: 3 ** 13 rows of a source, 3 ** 6 sources.
LEAF_LEVELS, GROUP_LEVELS = 13, 6
#: The low bit of the CRC-32 of a decimal number is that of the register's complement.
CRC_STEP = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
EVEN_CRC = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))), lambda c, b: {CRC_STEP}) & 1 = 1"


def manifest_levels() -> str:
    """Nodes of each level by group and place; then every leaf walks up, with what stands beside it; groups likewise."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(value(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {value(text)})"
    parts = [
        f"d AS MATERIALIZED (SELECT *, CASE WHEN {EVEN_CRC} THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents)",
        f"e AS MATERIALIZED (SELECT doc_id, source AS g, {leaf('text')} AS leaf, {leaf('cut')} AS seen FROM d)",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM e)",
        "n0 AS MATERIALIZED (SELECT g, p, n, leaf AS h FROM a0)",
        "w0 AS MATERIALIZED (SELECT doc_id, g, leaf, p, seen AS f, '' AS s FROM a0)",
    ]

    def climb(n: str, w: str, kept: str, count: int) -> None:
        for i in range(count):
            parts.append(f"r{n}{i} AS MATERIALIZED (SELECT g, p // 3 AS run, any_value(n) AS n, list(h ORDER BY p) AS hs FROM {n}{i} WHERE n > 1 GROUP BY g, p // 3)")
            parts.append(f"{n}{i + 1} AS MATERIALIZED (SELECT g, run AS p, (n + 2) // 3 AS n, sha256(array_to_string(hs, '')) AS h FROM r{n}{i} UNION ALL SELECT g, p, n, h FROM {n}{i} WHERE n = 1)")
            left, right = "array_to_string(hs[1:p % 3], '')", "array_to_string(hs[p % 3 + 2:], '')"
            parts.append(
                f"{w}{i + 1} AS MATERIALIZED (SELECT {kept}, w.g, CASE WHEN hs IS NULL THEN p ELSE p // 3 END AS p, CASE WHEN hs IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, s || CASE WHEN hs IS NULL THEN '' ELSE {left} || {right} END AS s "
                f"FROM {w}{i} w LEFT JOIN r{n}{i} r ON r.g IS NOT DISTINCT FROM w.g AND r.run = w.p // 3)"
            )

    climb("n", "w", "doc_id, leaf", LEAF_LEVELS)
    parts.append(f"m0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n, h, g AS source FROM n{LEAF_LEVELS})")
    parts.append(f"v0 AS MATERIALIZED (SELECT w.doc_id, w.leaf, m.h AS subroot, 0 AS g, m.p, w.f, w.s FROM w{LEAF_LEVELS} w JOIN m0 m ON m.source IS NOT DISTINCT FROM w.g)")
    climb("m", "v", "doc_id, leaf, subroot", GROUP_LEVELS)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, m.h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = m.h AS verified FROM v{GROUP_LEVELS}, m{GROUP_LEVELS} m"


SQL["op13_merkle_manifest"] = manifest_levels()
