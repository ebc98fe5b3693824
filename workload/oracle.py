"""SQL for the registered queries, written for DuckDB over the same tables.

Assembled from named common table expressions; every string in ORACLES is one statement.
"""

from __future__ import annotations

from textmatch.functions.stopwords import ENGLISH
from textmatch.functions.titles import (
    COMPARISON_MAP,
    COMPARISON_STOP,
    PRESERVED,
    SENIORITY,
    SPECIAL,
)
from workload.texts import INLINE_TEXTS

W = r"\p{L}\p{N}_"
S = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Open and close marks around words, and the mark in front of a preserved term.
O, C, P = "chr(1)", "chr(2)", "chr(57344)"
O_RE, C_RE, P_RE = r"\x01", r"\x02", r"\x{e000}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(lit(v) for v in values)


# --- text -------------------------------------------------------------------------------


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{S}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def clean(x: str) -> str:
    gone = lit("'\"!")
    return f"coalesce({collapse(f'translate({x}, {gone}, {lit(str())})')}, '')"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000 + 0.5) / 1000000)"


def pct(x: str) -> str:
    return f"(floor(({x}) * 10000 + 0.5) / 100)"


def r2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


def hash32(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


# --- titles -----------------------------------------------------------------------------

SPECIAL_UPPER = [w for w, shown in SPECIAL.items() if shown == w.upper()]


def mark_words(x: str) -> str:
    return rf"regexp_replace({x}, '([{W}]+)', {O} || '\1' || {C}, 'g')"


def unmark(x: str) -> str:
    return f"translate({x}, {O} || {C}, '')"


def sub(x: str, pattern: str, new: str, flags: str = "'g'") -> str:
    return f"regexp_replace({x}, '{pattern}', {new}, {flags})"


def standard(x: str, full: bool = True, strict: bool = False) -> str:
    t = strip(f"split_part({x}, ';', 1)")
    t = sub(t, rf"(?s)[{S}]*\|.*$", "''", "''")
    t = sub(t, rf"(?s)[{S}]*\(.*$", "''", "''")
    t = mark_words(f"replace({t}, '&', ' / ')")
    t = sub(t, rf"{O_RE}(?i:and){C_RE}", "' / '")
    t = unmark(sub(t, rf"{O_RE}\p{{Nd}}+{C_RE}", "''"))
    if full:
        t = sub(t, rf"(?i)^(fl|ft|pt|temp|contract|freelance)\.?[{S}]+", "''", "''")
    t = sub(t, rf"(?s)^[{S}]*([^,]*?)[{S}]*,.*$", r"'\1'", "''")
    if full and strict:
        # A word ends where no further word character follows: at the end, or before one.
        words = "|".join(s.replace(".", r"\.") for s in SENIORITY)
        t = sub(t, rf"(?i)^({words})(\.[{S}]*|[{S}]+|([^{W}])|$)", r"'\3'", "''")
    elif full:
        words = "|".join(s.replace(".", r"[^\n]") for s in SENIORITY)
        t = sub(t, rf"(?i)^({words})\.?[{S}]*", "''", "''")
    marked = unmark(
        sub(mark_words("lower(t)"), rf"{O_RE}({'|'.join(PRESERVED)}){C_RE}", rf"{P} || '\1'")
    )
    t = (
        f"list_transform([{t}], lambda t: CASE WHEN contains({marked}, {P}) "
        f"THEN {marked} ELSE t END)[1]"
    )
    hyphen = " ?- ?" if full else "-"
    t = sub(t, rf"([{W}]){hyphen}({P_RE})", r"'\1 \2'")
    t = sub(t, rf"({P_RE}[{W}]+){hyphen}([{W}])", r"'\1 \2'")
    for h in ("-", " -", "- ", " - ") if full else ("-",):
        t = sub(t, rf"([{W}]+){h}([{W}]+)", r"'\1\2'")
    t = sub(t, f"[{S}]*/[{S}]*", "' / '")
    for a, b in (("front", "end"), ("back", "end"), ("full", "stack")):
        gap = rf"({C_RE}[{S}-]+{O_RE})?"
        t = unmark(sub(mark_words(t), rf"{O_RE}(?i:{a}){gap}(?i:{b}){C_RE}", lit((a + b).title())))
    t = collapse(sub(t, "([a-z])([A-Z])", r"'\1 \2'"))
    if full:
        for w in ("frontend", "backend", "fullstack"):
            halves = "|".join(f"{w[:i]}  {w[i:]}" for i in range(1, len(w)))
            t = collapse(
                sub(f"' ' || replace({t}, ' ', '  ') || ' '", f"(?i) ({halves}) ", lit(f" {w.title()} "))
            )
    words = f"list_filter(string_split({t}, ' '), lambda w: w <> '')"
    if full:
        words = f"list_filter({words}, lambda w: lower(w) NOT IN ({names(SENIORITY)}))"
    core = rf"'^([^{P_RE}]*){P_RE}([{W}]+)(.*)$'"
    known = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in PRESERVED.items())
    kept = (
        f"regexp_extract(w, {core}, 1) || CASE regexp_extract(w, {core}, 2) {known} END || "
        f"translate(regexp_extract(w, {core}, 3), {P}, '')"
    )
    kept = kept.replace("CASE regexp_extract(w", "CASE lower(regexp_extract(w").replace(
        ", 2) WHEN", ", 2)) WHEN"
    )
    style = (
        f"CASE WHEN lower(w) = 'to' THEN 'to' WHEN lower(w) IN ({names(SPECIAL_UPPER)}) "
        f"THEN upper(w) WHEN contains(w, {P}) THEN {kept} "
        f"WHEN substr(w, 1, 1) = '\u00df' THEN 'Ss' || lower(substr(w, 2)) "
        f"ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END"
    )
    done = f"array_to_string(list_transform({words}, lambda w: {style}), ' ')"
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'Unknown Title' ELSE {done} END"


def normal(standardized: str, title: str) -> str:
    t = collapse(sub(f"lower({standardized})", f"[^{W}{S}]", "''"))
    stop = names(COMPARISON_STOP)
    words = f"list_filter(string_split({t}, ' '), lambda w: w <> '' AND w NOT IN ({stop}))"
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in COMPARISON_MAP.items())
    mapped = f"list_transform({words}, lambda w: CASE w {cases} ELSE w END)"
    return f"CASE WHEN coalesce({title}, '') = '' THEN '' ELSE array_to_string({mapped}, ' ') END"


# --- common table expressions -------------------------------------------------------------


def statement(ctes: list[tuple[str, str]], final: str, recursive: bool = False) -> str:
    seen: dict[str, str] = {}
    for name, body in ctes:
        seen.setdefault(name, body)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in seen.items())
    # A recursive expression carries its own column list and is not materialised by hint.
    parts = parts.replace("__REC AS MATERIALIZED", " AS")
    return f"WITH RECURSIVE {parts}\n{final}"


CORPUS = [
    (
        "corpus",
        f"SELECT doc_id AS id, {standard('source')} AS title, {clean('text')} AS text "
        "FROM documents",
    )
]
ASKED = [("asked", f"SELECT item_id AS id, {clean('text')} AS text FROM benchmark")]


def term_rows(name: str, source: str, keys: str, text: str = "text") -> list[tuple[str, str]]:
    """``<name>_tf (keys, term, tf)`` of the unigrams and bigrams without stop words."""
    stop = names(ENGLISH)
    found = (
        f"list_filter(regexp_extract_all(lower({text}), '[{W}]{{2,}}'), "
        f"lambda w: w NOT IN ({stop}))"
    )
    return [
        (f"{name}_words", f"SELECT {keys}, {found} AS w FROM {source}"),
        (
            f"{name}_terms",
            f"SELECT {keys}, unnest(list_concat(w, list_transform(range(1, len(w)), "
            f"lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_words",
        ),
        (
            f"{name}_tf",
            f"SELECT {keys}, term, count(*) AS tf FROM {name}_terms GROUP BY {keys}, term",
        ),
    ]


VOCAB = (
    CORPUS
    + term_rows("corpus", "corpus", "id")
    + [
        (
            "vocab",
            "SELECT term, df, ctf, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE "
            "AS idf FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM corpus_tf "
            "GROUP BY term), (SELECT count(*) AS n FROM corpus) "
            "WHERE df >= 5 AND df <= 0.85 * n ORDER BY ctf DESC, term LIMIT 10000",
        )
    ]
)


def vectors(name: str, keys: str) -> list[tuple[str, str]]:
    """``<name>_vec (keys, term, w)`` from ``<name>_tf``."""
    return [
        (
            f"{name}_vec",
            f"SELECT {keys}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER "
            f"(PARTITION BY {keys})) AS w FROM {name}_tf JOIN vocab USING (term)",
        )
    ]


def boost(name: str, source: str, sep: str = "") -> list[tuple[str, str]]:
    """``<name>_boosted (id, text)`` from ``<name>_vec``."""
    times = f"least(5, greatest(1, floor({r6('w')} * 10)::INT))"
    repeated = (
        f"' ' || repeat(term, {times})"
        if not sep
        else f"' ' || array_to_string(list_transform(range(0, {times}), lambda i: term), ' ')"
    )
    return [
        (
            f"{name}_ranked",
            f"SELECT id, term, w, row_number() OVER (PARTITION BY id ORDER BY {r6('w')} DESC, "
            f"term) AS place, row_number() OVER (PARTITION BY id ORDER BY term) AS alpha, "
            f"count(*) OVER (PARTITION BY id) AS n FROM {name}_vec",
        ),
        (
            f"{name}_boosted{'_spaced' if sep else ''}",
            f"SELECT s.id, s.text || coalesce(b.more, '') AS text FROM {source} s LEFT JOIN "
            f"(SELECT id, string_agg({repeated}, '' ORDER BY CASE WHEN n > 20 THEN -place "
            f"ELSE alpha END) AS more FROM {name}_ranked WHERE place <= 20 GROUP BY id) b "
            "ON s.id = b.id",
        ),
    ]


def chunks(name: str, source: str) -> list[tuple[str, str]]:
    """``<name>_chunks (id, chunk_idx, chunk)`` of ``source (id, text)``."""

    def stop(begin: str) -> str:
        piece = f"substr(text, {begin} + 1, 2048)"
        at = f"length(regexp_extract({piece}, '(?s)^(.*) [^ ]*$', 1))"
        return (
            f"CASE WHEN {begin} + 2048 < length(text) AND contains({piece}, ' ') AND {at} > 0 "
            f"THEN {begin} + {at} ELSE {begin} + 2048 END"
        )

    return [
        (
            f"{name}_cuts__REC",
            f"SELECT id, text, 0::BIGINT AS lo, {stop('0::BIGINT')} AS hi FROM {source} "
            "WHERE length(text) > 2048 UNION ALL "
            f"SELECT id, text, lo, {stop('lo')} FROM (SELECT id, text, "
            f"greatest(lo + 1, hi - 200) AS lo FROM {name}_cuts) WHERE lo < length(text)",
        ),
        (
            f"{name}_chunks",
            "SELECT id, row_number() OVER (PARTITION BY id ORDER BY lo) - 1 AS chunk_idx, "
            "chunk FROM (SELECT id, lo, trim(substr(text, lo + 1, hi - lo)) AS chunk FROM "
            f"{name}_cuts) WHERE chunk <> '' UNION ALL "
            f"SELECT id, 0, text FROM {source} WHERE length(text) <= 2048",
        ),
    ]


def mean_vectors(name: str) -> list[tuple[str, str]]:
    """``<name>_mean (id, term, w)`` over the chunks in ``<name>_chunks``."""
    c = f"{name}_c"
    return (
        term_rows(c, f"{name}_chunks", "id, chunk_idx", "chunk")
        + vectors(c, "id, chunk_idx")
        + [
            (f"{name}_n", f"SELECT id, count(*) AS n FROM {name}_chunks GROUP BY id"),
            (
                f"{name}_mean",
                f"SELECT id, term, sum(w) / any_value(n) AS w FROM {c}_vec JOIN {name}_n "
                "USING (id) GROUP BY id, term",
            ),
        ]
    )


def embeddings(name: str, dim: int = 1024) -> list[tuple[str, str]]:
    """``<name>_emb (id, pos, value)``, the non-zero cells."""
    c = f"{name}_c"
    slot = f"{hash32('term')} % {dim}"
    sign = "CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
    return (
        term_rows(c, f"{name}_chunks", "id, chunk_idx", "chunk")
        + vectors(c, "id, chunk_idx")
        + [
            (
                f"{name}_cell",
                f"SELECT id, chunk_idx, {slot} AS pos, sum(w * {sign}) AS v FROM {c}_vec "
                "GROUP BY ALL",
            ),
            (
                f"{name}_unit",
                "SELECT id, chunk_idx, pos, v / sqrt(sum(v * v) OVER (PARTITION BY id, "
                f"chunk_idx)) AS v FROM {name}_cell",
            ),
            (f"{name}_n", f"SELECT id, count(*) AS n FROM {name}_chunks GROUP BY id"),
            (
                f"{name}_pool",
                f"SELECT id, pos, sum(v) / any_value(n) AS v FROM {name}_unit JOIN {name}_n "
                "USING (id) GROUP BY id, pos",
            ),
            (
                f"{name}_emb",
                "SELECT id, pos, (v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE "
                f"AS value FROM {name}_pool",
            ),
        ]
    )


def cosines(q: str, d: str, qs: str, ds: str, key: str, value: str) -> list[tuple[str, str]]:
    """``scored (query_id, id, score)`` of every query in ``qs`` and row of ``ds``."""

    def length(t: str) -> str:
        return f"SELECT id, sqrt(sum({value} * {value})) AS len FROM {t} GROUP BY id"

    return [
        ("q_len", length(q)),
        ("d_len", length(d)),
        (
            "dots",
            f"SELECT q.id AS query_id, d.id, sum(q.{value} * d.{value}) AS dot FROM {q} q "
            f"JOIN {d} d USING ({key}) GROUP BY q.id, d.id",
        ),
        (
            "scored",
            "SELECT qs.id AS query_id, ds.id, CASE WHEN dot IS NULL OR ql.len = 0 OR "
            "dl.len = 0 THEN 0.0::DOUBLE ELSE dot / (ql.len * dl.len) END AS score FROM "
            f"(SELECT id FROM {qs}) qs CROSS JOIN (SELECT id FROM {ds}) ds LEFT JOIN dots "
            "ON dots.query_id = qs.id AND dots.id = ds.id LEFT JOIN q_len ql ON ql.id = qs.id "
            "LEFT JOIN d_len dl ON dl.id = ds.id",
        ),
    ]


def best(k: int | None) -> list[tuple[str, str]]:
    """``best (query_id, id, score, rank)``."""
    return [
        (
            "best",
            "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY "
            "query_id ORDER BY floor(score * 1000000 + 0.5) DESC, id) AS rank FROM scored) "
            + (f"WHERE rank <= {k}" if k else ""),
        )
    ]


def deduped(source: str, n: int | None, full: bool, score: bool) -> list[tuple[str, str]]:
    """``shown``: one row per query and normalised title, ranked."""
    key = normal("title", "title") if full else "lower(title)"
    order = "similarity_percentage DESC, "
    if score:
        order += "floor(score * 1000000 + 0.5) DESC, "
    order += "id"
    limit = "" if n is None else f"WHERE rank <= {n}"
    return [
        ("keyed", f"SELECT *, {key} AS norm_title FROM {source}"),
        (
            "shown",
            "SELECT * FROM (SELECT * EXCLUDE (copy), row_number() OVER (PARTITION BY query_id "
            f"ORDER BY {order}) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "
            f"query_id, norm_title ORDER BY {order}) AS copy FROM keyed) WHERE copy = 1) "
            f"{limit}",
        ),
    ]


def present(n: int, full: bool, corpus: str = "corpus") -> list[tuple[str, str]]:
    return [
        (
            "found",
            f"SELECT b.query_id, b.id, c.title, {pct('b.score')} AS similarity_percentage, "
            f"c.text AS embedding_text, b.score FROM best b JOIN {corpus} c ON c.id = b.id",
        )
    ] + deduped("found", n, full, True)


def matched(n: int = 5, asked=ASKED) -> list[tuple[str, str]]:
    """``shown`` of the embedding match of ``asked`` against the documents."""
    out = list(VOCAB) + list(asked)
    out += vectors("corpus", "id") + boost("corpus", "corpus")
    out += chunks("corpus", "corpus_boosted") + embeddings("corpus")
    out += term_rows("asked", "asked", "id") + vectors("asked", "id")
    out += boost("asked", "asked") + chunks("asked", "asked_boosted") + embeddings("asked")
    out += cosines("asked_emb", "corpus_emb", "asked", "corpus", "pos", "value")
    return out + best(3 * n) + present(n, True)


def matched_lite(asked, corpus=VOCAB, n: int = 5) -> list[tuple[str, str]]:
    """``shown`` of the TF-IDF match of ``asked`` against ``corpus``."""
    out = list(corpus) + list(asked) + vectors("corpus", "id")
    out += term_rows("asked", "asked", "id") + vectors("asked", "id")
    out += boost("asked", "asked") + chunks("asked", "asked_boosted") + mean_vectors("asked")
    out += cosines("asked_mean", "corpus_vec", "asked", "corpus", "term", "w")
    return out + best(3 * n) + present(n, False)


SHOWN = (
    "SELECT query_id, rank, id, title, similarity_percentage, "
    f"{r6('avg(similarity_percentage) OVER (PARTITION BY query_id)')} AS avg_similarity "
    "FROM shown"
)

# --- persons ------------------------------------------------------------------------------

PERSONS = [
    (
        "seen",
        "SELECT o_custkey AS pid, l_partkey, min((l_orderkey, l_linenumber)) AS seq FROM "
        "lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey",
    ),
    (
        "details",
        "SELECT pid, seq, p_name, p_type FROM seen JOIN part ON l_partkey = p_partkey",
    ),
]


def concat_by(name: str, source: str, pid: str, value: str, seq: str) -> list[tuple[str, str]]:
    return [
        (
            name,
            f"SELECT {pid} AS pid, string_agg(v, '; ' ORDER BY s, v) AS v FROM (SELECT {pid}, "
            f"{value} AS v, min({seq}) AS s FROM {source} GROUP BY {pid}, {value}) "
            f"GROUP BY {pid}",
        )
    ]


PROFILES = (
    PERSONS
    + concat_by("abilities", "orders", "o_custkey", clean("o_orderpriority"), "o_orderkey")
    + concat_by(
        "titles", "details", "pid", strip(f"split_part({clean('p_name')}, ';', 1)"), "seq"
    )
    + concat_by("skills", "details", "pid", clean("p_type"), "seq")
    + [
        (
            "profiles",
            "SELECT c_custkey::INT AS person_id, a.v AS ability, t.v AS title, s.v AS skill "
            "FROM customer LEFT JOIN abilities a ON a.pid = c_custkey LEFT JOIN titles t ON "
            "t.pid = c_custkey LEFT JOIN skills s ON s.pid = c_custkey",
        )
    ]
)
PREPARED = PROFILES + [
    (
        "kept",
        "SELECT min(person_id) AS person_id, ability, title, skill FROM profiles GROUP BY "
        "ability, title, skill",
    ),
    (
        "filled",
        "SELECT person_id, coalesce(ability, 'Unknown ability') AS ability, "
        f"{standard('title')} AS title, coalesce(skill, 'Unknown skill') AS skill FROM kept",
    ),
    (
        "prepared",
        f"SELECT *, {clean('ability')} || ' | ' || repeat({collapse('title')}, 3) || ' | ' || "
        f"{clean('skill')} AS embedding_text FROM filled",
    ),
]
PREPARED_FINAL = "SELECT person_id, ability, title, skill, embedding_text FROM prepared"

TITLES = [
    (
        "all_titles",
        "SELECT p_name AS title FROM part UNION SELECT p_type FROM part UNION "
        "SELECT p_name || ' - ' || p_type FROM part UNION SELECT o_orderpriority FROM orders "
        "UNION SELECT regexp_extract(html, '(?is)<title>(.*?)</title>', 1) FROM pages",
    )
]
BRANDS = [
    (
        "brands",
        f"SELECT p_brand AS query_id, p_partkey AS id, {standard('p_name')} AS title, "
        "p_retailprice AS similarity_percentage FROM part",
    )
]

# --- metrics ------------------------------------------------------------------------------

POOLED = [
    (
        "cells",
        "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, "
        "unnest(range(0, len(embedding))) AS pos FROM embeddings",
    ),
    ("pooled", "SELECT label, pos, avg(v) AS v FROM cells GROUP BY label, pos"),
]
CENTRES = POOLED + [
    ("centre", "SELECT label AS id, pos, v FROM pooled"),
    ("item", "SELECT vec_id AS id, pos, v FROM cells"),
    ("centre_ids", "SELECT DISTINCT label AS id FROM embeddings"),
    ("item_ids", "SELECT vec_id AS id FROM embeddings"),
]
SEARCH = CENTRES + cosines("centre", "item", "centre_ids", "item_ids", "pos", "v") + best(15)
RANKED = (
    CENTRES
    + [
        ("item_s", "SELECT id::VARCHAR AS id, pos, v FROM item"),
        ("item_ids_s", "SELECT id::VARCHAR AS id FROM item_ids"),
    ]
    + cosines("centre", "item_s", "centre_ids", "item_ids_s", "pos", "v")
    + best(None)
    + [
        ("ranking", "SELECT query_id::VARCHAR AS query_id, id AS item_id, rank FROM best"),
        (
            "truth",
            "SELECT near::VARCHAR AS query_id, vec_id::VARCHAR AS item_id, CASE WHEN near = "
            "label THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS relevance FROM (SELECT vec_id, "
            "label, unnest([label - 1, label, label + 1]) AS near FROM embeddings)",
        ),
    ]
)
BY_SOURCE = [
    (
        "ranking",
        "SELECT source AS query_id, doc_id AS item_id, row_number() OVER "
        "(PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents",
    ),
    (
        "truth",
        "SELECT source AS query_id, doc_id AS item_id, (quality + toxic)::DOUBLE AS relevance "
        "FROM labels JOIN documents USING (doc_id)",
    ),
]


def scored_metrics(thresholds, ks=(3, 5, 10)) -> list[tuple[str, str]]:
    """``metrics (query_id, metric, k, threshold, value, valid)`` from ranking and truth."""
    ts = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    kv = ", ".join(f"({k})" for k in ks)
    return [
        ("ts", f"SELECT * FROM (VALUES {ts}) x(t)"),
        ("ks", f"SELECT * FROM (VALUES {kv}) x(k)"),
        (
            "qs",
            "SELECT DISTINCT query_id FROM ranking WHERE query_id IN "
            "(SELECT query_id FROM truth)",
        ),
        (
            "judged",
            "SELECT r.query_id, r.item_id, r.rank, t.relevance FROM ranking r JOIN qs "
            "USING (query_id) LEFT JOIN truth t ON t.query_id = r.query_id AND "
            "t.item_id = r.item_id",
        ),
        (
            "ideal",
            "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS "
            "place FROM truth",
        ),
        (
            "gain",
            "SELECT query_id, k, sum(coalesce(relevance, 0) / log2(rank + 1)) AS dcg FROM "
            "judged, ks WHERE rank <= k GROUP BY ALL",
        ),
        (
            "best_gain",
            "SELECT query_id, k, sum(relevance / log2(place + 1)) AS idcg FROM ideal, ks "
            "WHERE place <= k GROUP BY ALL",
        ),
        (
            "hits",
            "SELECT query_id, item_id, rank, t, coalesce(relevance >= t, false) AS hit, "
            "relevance FROM judged, ts",
        ),
        (
            "known",
            "SELECT query_id, t, count(*) FILTER (WHERE relevance >= t) AS known FROM truth, "
            "ts GROUP BY ALL",
        ),
        (
            "at_k",
            "SELECT query_id, t, k, count(*) FILTER (WHERE hit) AS h, count(*) AS n FROM hits, "
            "ks WHERE rank <= k GROUP BY ALL",
        ),
        (
            "running",
            "SELECT *, sum(hit::INT) OVER (PARTITION BY query_id, t ORDER BY rank) AS run "
            "FROM hits",
        ),
        (
            "lists",
            "SELECT query_id, t, min(rank) FILTER (WHERE hit) AS first_hit, "
            "sum(run / rank) FILTER (WHERE hit) AS ap FROM running GROUP BY ALL",
        ),
        (
            "labels_all",
            "SELECT query_id, item_id, t, rank, (rank - 1) // 5 AS p, CASE WHEN hit THEN "
            "trunc(relevance)::INT ELSE 0 END AS l FROM hits WHERE relevance IS NOT NULL",
        ),
        (
            "labels_last",
            "SELECT * FROM labels_all QUALIFY row_number() OVER (PARTITION BY query_id, "
            "item_id, t ORDER BY rank DESC) = 1",
        ),
        (
            "cell",
            "SELECT query_id, t, p, l, count(*)::DOUBLE AS n FROM labels_last GROUP BY ALL",
        ),
        (
            "tot",
            "SELECT query_id, t, sum(n) AS n, sum(n * n) AS s, sum(n * ln(n)) AS hs, "
            "count(DISTINCT l) AS nl, count(DISTINCT p) AS np FROM cell GROUP BY ALL",
        ),
        (
            "row_l",
            "SELECT query_id, t, sum(n * n) AS a, sum(n * ln(n)) AS ha FROM (SELECT query_id, "
            "t, l, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL",
        ),
        (
            "row_p",
            "SELECT query_id, t, sum(n * n) AS b, sum(n * ln(n)) AS hb FROM (SELECT query_id, "
            "t, p, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL",
        ),
        (
            "pairs",
            "SELECT query_id, t, n, nl, np, s - n AS tp, a - s AS u, b - s AS v, "
            "n * n - a - b + s AS tn, (hs - ha - hb) / n + ln(n) AS mi, "
            "ln(n) - ha / n AS hl, ln(n) - hb / n AS hp FROM tot JOIN row_l USING "
            "(query_id, t) JOIN row_p USING (query_id, t)",
        ),
        (
            "pure",
            "SELECT query_id, t, sum(top) / sum(n) AS purity FROM (SELECT query_id, t, p, "
            "max(c) AS top, sum(c) AS n FROM (SELECT query_id, t, p, l, count(*) AS c FROM "
            "labels_all GROUP BY ALL) GROUP BY ALL) GROUP BY ALL",
        ),
        (
            "metrics",
            "SELECT query_id, 'ndcg' AS metric, k, NULL::DOUBLE AS threshold, CASE WHEN "
            "idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS value, idcg > 0 AS valid "
            "FROM qs CROSS JOIN ks LEFT JOIN gain USING (query_id, k) LEFT JOIN best_gain "
            "USING (query_id, k) "
            "UNION ALL SELECT query_id, 'precision', k, t, coalesce(h / n, 0), "
            "coalesce(n, 0) > 0 FROM qs CROSS JOIN ks CROSS JOIN ts LEFT JOIN at_k USING "
            "(query_id, k, t) "
            "UNION ALL SELECT query_id, 'recall', k, t, CASE WHEN known = 0 THEN 1 ELSE "
            "coalesce(h, 0) / known END, true FROM qs CROSS JOIN ks CROSS JOIN ts JOIN known "
            "USING (query_id, t) LEFT JOIN at_k USING (query_id, k, t) "
            "UNION ALL SELECT query_id, 'mrr', NULL, t, coalesce(1.0::DOUBLE / first_hit, 0), "
            "true FROM qs CROSS JOIN ts LEFT JOIN lists USING (query_id, t) "
            "UNION ALL SELECT query_id, 'map', NULL, t, CASE WHEN known = 0 THEN 1 ELSE "
            "coalesce(ap, 0) / known END, true FROM qs CROSS JOIN ts JOIN known USING "
            "(query_id, t) LEFT JOIN lists USING (query_id, t) "
            "UNION ALL SELECT query_id, 'ari', NULL, t, CASE WHEN n IS NULL OR n < 2 THEN 0 "
            "WHEN u = 0 AND v = 0 THEN 1 ELSE 2 * (tp * tn - u * v) / ((tp + u) * (u + tn) + "
            "(tp + v) * (v + tn)) END, true FROM qs CROSS JOIN ts LEFT JOIN pairs USING "
            "(query_id, t) "
            "UNION ALL SELECT query_id, 'nmi', NULL, t, CASE WHEN n IS NULL OR n < 2 THEN 0 "
            "WHEN nl = 1 AND np = 1 THEN 1 WHEN mi <= 1e-12 THEN 0 ELSE mi / ((hl + hp) / 2) "
            "END, true FROM qs CROSS JOIN ts LEFT JOIN pairs USING (query_id, t) "
            "UNION ALL SELECT query_id, 'purity', NULL, t, coalesce(purity, 0), true FROM qs "
            "CROSS JOIN ts LEFT JOIN pure USING (query_id, t)",
        ),
        (
            "means",
            "SELECT metric, k, threshold, coalesce(sum(value) / nullif(count(*) FILTER "
            "(WHERE valid), 0), 0) AS value, count(*) FILTER (WHERE valid) AS queries FROM "
            "metrics GROUP BY ALL",
        ),
    ]


GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0)
ONE = RANKED + scored_metrics((1.0,))
MANY = RANKED + scored_metrics(GRID)


def one_metric(name: str, with_k: bool) -> str:
    k = "k, " if with_k else ""
    return statement(
        ONE,
        f"SELECT query_id, {k}{r6('value')} AS value, valid FROM metrics "
        f"WHERE metric = '{name}'",
    )


def f1_rows(source: str = "means") -> list[tuple[str, str]]:
    return [
        (
            "f1s",
            "SELECT threshold, precision, recall, CASE WHEN precision + recall > 0 THEN "
            "2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT "
            "threshold, max(value) FILTER (WHERE metric = 'precision') AS precision, "
            f"max(value) FILTER (WHERE metric = 'recall') AS recall FROM {source} WHERE k = 5 "
            "AND metric IN ('precision', 'recall') GROUP BY threshold)",
        ),
        (
            "chosen",
            "SELECT CASE WHEN f1 <= 0 THEN 1.0::DOUBLE ELSE threshold END AS threshold, f1, "
            "precision, recall FROM f1s ORDER BY floor(f1 * 1e12) DESC, CASE WHEN f1 <= 0 "
            "AND threshold = 1.0 THEN 0 ELSE 1 END, threshold LIMIT 1",
        ),
    ]


# --- title overlap and sampled truth --------------------------------------------------------


def words_of(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[{S}]+'), lambda w: w <> ''))"


def overlaps(titles: str, mapping: str) -> list[tuple[str, str]]:
    """``overlap (title, item_id, overlap)`` for the lower-case titles in ``titles``."""
    return [
        ("wanted", f"SELECT DISTINCT lower(title) AS title FROM {titles}"),
        (
            "shared",
            f"SELECT w.title, m.item_id, m.seq, len(list_intersect({words_of('w.title')}, "
            f"{words_of('m.title')})) AS n FROM wanted w CROSS JOIN {mapping} m",
        ),
        (
            "overlap",
            "SELECT title, CASE WHEN n > 0 THEN item_id ELSE 'job_' || "
            f"({hash32('title')} % 10000) END AS item_id, n::INT AS overlap FROM shared "
            "QUALIFY row_number() OVER (PARTITION BY title ORDER BY n DESC, seq) = 1",
        ),
    ]


def mapping_of(source: str) -> str:
    return (
        "SELECT lower(title) AS title, arg_max(item_id, seq) AS item_id, min(seq) AS seq "
        f"FROM {source} GROUP BY lower(title)"
    )


PART_ITEMS = [
    (
        "items",
        "SELECT p_partkey::VARCHAR AS item_id, p_name AS title, p_partkey AS seq FROM part",
    ),
    ("mapping", mapping_of("items")),
]
SAMPLED = CORPUS + [
    (
        "first_titles",
        "SELECT title, row_number() OVER (ORDER BY first_id, title) - 1 AS i FROM (SELECT "
        "title, min(id) AS first_id FROM corpus GROUP BY title) ORDER BY first_id, title "
        "LIMIT 20",
    ),
    (
        "listed",
        "SELECT n::INT AS n, title AS item_title FROM (SELECT unnest(range(0, 20)) AS n), "
        "(SELECT count(*) AS size FROM first_titles) JOIN first_titles ON i = n % size",
    ),
    (
        "pairs_drawn",
        "SELECT 'resume_' || q AS query_id, 'job_' || n AS item_id, item_title, n AS seq FROM "
        "listed, (SELECT unnest(range(1, 11)) AS q)",
    ),
    (
        "sampled",
        "SELECT query_id, item_id, item_title, seq, CASE WHEN draw < 0.4 THEN 0.0::DOUBLE "
        "WHEN draw < 0.7 THEN 1.0 WHEN draw < 0.9 THEN 2.0 ELSE 3.0 END AS relevance FROM "
        f"(SELECT *, {hash32(repr('42|') + ' || query_id || ' + repr('|') + ' || item_id')} / "
        "4294967296.0::DOUBLE AS draw FROM pairs_drawn)",
    ),
]
SAMPLE_TEXTS = [
    (
        "asked",
        "SELECT 'resume_' || row_number() OVER (ORDER BY draw, id) AS id, text FROM (SELECT "
        "md5('42|' || id) AS draw, id, text FROM corpus) ORDER BY draw, id LIMIT 10",
    )
]


def evaluated() -> str:
    out = SAMPLED + matched(10, SAMPLE_TEXTS)
    out += [
        (
            "items",
            "SELECT item_id, arg_max(item_title, seq) AS title, min(seq) AS seq FROM sampled "
            "GROUP BY item_id",
        ),
        ("mapping", mapping_of("items")),
    ]
    out += overlaps("shown", "mapping")
    out += [
        (
            "ranking",
            "SELECT query_id, item_id, rank FROM shown JOIN overlap ON overlap.title = "
            "lower(shown.title)",
        ),
        ("truth", "SELECT query_id, item_id, relevance FROM sampled"),
    ]
    # A title may stand for an item twice in one ranking: running counts go by rank.
    out += scored_metrics(GRID) + f1_rows()
    return statement(
        out,
        f"SELECT metric, k, threshold, {r6('value')} AS value, queries FROM means WHERE "
        "threshold IS NULL OR threshold = (SELECT threshold FROM chosen)",
    )


# --- pages ----------------------------------------------------------------------------------

PAGE_FILES = [
    (
        "files",
        "SELECT '/scan/page_' || page_id || ['.pdf', '.DOCX', '.doc', '.txt']"
        "[length(html) % 4 + 1] AS path, html FROM pages",
    )
]

PAGE_TEXT = PAGE_FILES + [
    (
        "bare",
        "SELECT path, list_transform(string_split_regex("
        + sub(
            sub(
                sub(
                    sub("html", r"(?is)<script\b.*?</script[^>]*>", "' '"),
                    r"(?is)<style\b.*?</style[^>]*>",
                    "' '",
                ),
                r"(?is)<nav\b.*?</nav[^>]*>",
                "' '",
            ),
            "(?s)<!--.*?-->",
            "' '",
        )
        + r", '(?i)<(?:br|p|div|h[1-6]|li|tr)\b[^>]*>'), lambda x: "
        + sub("x", "(?s)<[^>]*>", "''")
        + ") AS pages FROM files WHERE NOT path LIKE '%.txt'",
    ),
    (
        "page_texts",
        "SELECT path, "
        + clean(
            "regexp_replace(replace(replace(replace(array_to_string(pages, ' '), '&copy;', "
            "'\u00a9'), '&middot;', '\u00b7'), '&quot;', '\"'), '&amp;?', '&', 'g')"
        )
        + " AS text FROM bare",
    ),
]

SUMMARY = (
    "SELECT count(*) AS total_cvs, "
    f"{r2('coalesce(avg(mean), 0)')} AS average_similarity, "
    f"{r2('greatest(coalesce(max(mean), 0), 0)')} AS highest_avg_similarity, "
    f"{r2('least(coalesce(min(mean), 100), 100)')} AS lowest_avg_similarity, "
    f"{r2('greatest(coalesce(max(high), 0), 0)')} AS highest_individual_match, "
    f"{r2('least(coalesce(min(low), 100), 100)')} AS lowest_individual_match, "
    f"{r2('coalesce(stddev_pop(mean), 0)')} AS standard_deviation FROM (SELECT query_id, "
    "avg(similarity_percentage) AS mean, max(similarity_percentage) AS high, "
    "min(similarity_percentage) AS low FROM shown GROUP BY query_id)"
)

STOP = names(ENGLISH)
SHORT_CLEAN = cut(clean("text"), 30)

ORACLES: dict[str, str] = {
    "clean_text_docs": (
        f"SELECT doc_id, length({clean('text')}) AS clean_chars, md5({clean('text')}) AS "
        f"clean_md5, length(coalesce({collapse('text')}, '')) AS title_chars, "
        "substr(md5(text), 1, 8) AS text_hash, "
        f"{strip('translate(substr(text, 1, 200), chr(10), chr(32))')} AS text_preview, "
        f"{SHORT_CLEAN} AS short_text FROM documents"
    ),
    "standardize_titles": statement(
        TITLES,
        f"SELECT title, {standard('title')} AS standard, {standard('title', strict=True)} AS "
        "standard_strict FROM all_titles",
    ),
    "standardize_titles_lite": statement(
        TITLES + [("s", f"SELECT title, {standard('title', False)} AS standard FROM all_titles")],
        "SELECT title, standard, lower(standard) AS normal FROM s",
    ),
    "normalize_titles": statement(
        TITLES + [("s", f"SELECT title, {standard('title')} AS standard FROM all_titles")],
        f"SELECT title, {normal('standard', 'title')} AS normal FROM s",
    ),
    "dedup_titles_full": statement(
        BRANDS + deduped("brands", 5, True, False),
        "SELECT query_id, rank, id, title, similarity_percentage FROM shown",
    ),
    "dedup_titles_lite": statement(
        BRANDS + deduped("brands", None, False, False),
        "SELECT query_id, id, title, similarity_percentage FROM shown",
    ),
    "group_concat": statement(
        concat_by("a", "orders", "o_custkey", "o_orderpriority", "o_orderkey")
        + concat_by("b", "orders", "o_custkey", "o_orderstatus", "o_orderkey"),
        "SELECT a.pid AS o_custkey, a.v AS o_orderpriority, b.v AS o_orderstatus FROM a JOIN "
        "b USING (pid)",
    ),
    "distinct_keys": "SELECT DISTINCT o_custkey FROM orders",
    "person_profiles": statement(PROFILES, "SELECT * FROM profiles"),
    "prepared_corpus": statement(PREPARED, PREPARED_FINAL),
    "person_csv_corpus": statement(PREPARED, PREPARED_FINAL),
    "content_dedup_docs": (
        "SELECT min(doc_id) AS doc_id, lang, source, n_chars, md5(text) AS h FROM documents "
        "GROUP BY text, lang, source, n_chars"
    ),
    "dedup_statistics": (
        "SELECT n AS initial_rows, d AS kept_rows, n - d AS removed_rows, "
        f"{r2('(n - d) * 100.0::DOUBLE / n')} AS removed_percent FROM (SELECT count(*) AS n, "
        "(SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS d "
        "FROM documents)"
    ),
    "profile_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS "
        f"distinct_values, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, "
        f"count(DISTINCT {c}) < 0.5 * count(*) AS low_cardinality, {kind} AS suggested_type "
        "FROM documents"
        for c, kind in [
            (c, f"CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN "
                f"min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' WHEN min({c}) >= "
                f"-2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END")
            for c in ("doc_id", "n_chars")
        ] + [
            (c, f"CASE WHEN count(DISTINCT {c}) < 0.5 * count(*) THEN 'dictionary' ELSE "
                "'string' END")
            for c in ("text", "lang", "source")
        ]
    ),
    "tokenize_ngrams": statement(
        CORPUS + term_rows("corpus", "corpus", "id"),
        "SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM corpus_tf GROUP BY term",
    ),
    "stopword_counts": statement(
        [
            (
                "t",
                f"SELECT doc_id, regexp_extract_all(lower({clean('text')}), '[{W}]{{2,}}') AS w "
                "FROM documents",
            )
        ],
        f"SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: x NOT IN ({STOP}))) "
        "AS n_kept FROM t",
    ),
    "vocabulary_terms": statement(
        VOCAB, f"SELECT term, df, ctf, {r6('idf')} AS idf FROM vocab"
    ),
    "index_terms_grown": statement(
        VOCAB, f"SELECT term, df, ctf, {r6('idf')} AS idf FROM vocab"
    ),
    "index_changes": (
        "WITH n AS (SELECT count(*) AS rows, sum((doc_id % 3 = 0)::INT)::BIGINT AS new, "
        "sum((doc_id % 3 = 2 OR doc_id % 15 = 10)::INT)::BIGINT AS other FROM documents) "
        "SELECT 1 AS step, 1 AS version, rows AS added, 0::BIGINT AS changed, 0::BIGINT AS removed "
        "FROM n UNION ALL SELECT 2, 2, new, other, new FROM n UNION ALL SELECT 3, 2, 0, 0, 0 FROM n"
    ),
    "tfidf_vectors": statement(
        VOCAB + vectors("corpus", "id"),
        f"SELECT id, term, {r6('w')} AS weight FROM corpus_vec",
    ),
    "top_terms_docs": statement(
        VOCAB + vectors("corpus", "id") + boost("corpus", "corpus")[:1],
        f"SELECT id, place, term, {r6('w')} AS weight FROM corpus_ranked WHERE place <= 20",
    ),
    "tfidf_boost": statement(
        VOCAB + vectors("corpus", "id") + boost("corpus", "corpus") + boost("corpus", "corpus", " "),
        "SELECT id, md5(a.text) AS literal_md5, md5(b.text) AS spaced_md5 FROM corpus_boosted "
        "a JOIN corpus_boosted_spaced b USING (id)",
    ),
    "chunk_documents": statement(
        CORPUS + chunks("corpus", "corpus"),
        "SELECT id, chunk_idx, length(chunk) AS chunk_chars, md5(chunk) AS chunk_md5 FROM "
        "corpus_chunks",
    ),
    "chunk_documents_sql": statement(
        CORPUS + chunks("corpus", "corpus"),
        "SELECT id, chunk_idx, length(chunk) AS chunk_chars, md5(chunk) AS chunk_md5 FROM "
        "corpus_chunks",
    ),
    "chunk_mean_tfidf": statement(
        VOCAB + chunks("corpus", "corpus") + mean_vectors("corpus"),
        f"SELECT id, term, {r6('w')} AS weight FROM corpus_mean",
    ),
    "normalize_vectors": statement(
        POOLED[:1],
        f"SELECT vec_id, {r6('sqrt(sum(v * v))')} AS length, "
        f"{r6('sum(2 * v) / sqrt(sum(4 * v * v))')} AS total, "
        f"{r6('sum(v * 2 * v) / (sqrt(sum(v * v)) * sqrt(sum(4 * v * v)))')} AS self_cosine, "
        "0.0::DOUBLE AS zero_cosine FROM cells GROUP BY vec_id",
    ),
    "mean_pool_labels": statement(
        POOLED,
        f"SELECT label, pos, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY label))')} AS value "
        "FROM pooled",
    ),
    "cosine_topk": statement(
        SEARCH, f"SELECT query_id, rank, id, {r6('score')} AS score FROM best"
    ),
    "dedup_without_titles": statement(
        SEARCH, f"SELECT query_id, rank, id, {r6('score')} AS score FROM best"
    ),
    "index_recall": (
        "SELECT (sum((vec_id % 50 = 0)::INT) * least(15, count(*)))::BIGINT AS wanted, "
        "true AS recall_reached, true AS fewer_pairs_scored FROM embeddings"
    ),
    "cosine_topk_blocked": statement(
        SEARCH, f"SELECT query_id, rank, id, {r6('score')} AS score FROM best"
    ),
    "hash_embed": statement(
        VOCAB
        + vectors("corpus", "id")
        + boost("corpus", "corpus")
        + chunks("corpus", "corpus_boosted")
        + embeddings("corpus"),
        f"SELECT id, pos, {r6('value')} AS value FROM corpus_emb WHERE {r6('value')} <> 0",
    ),
    "tfidf_topk": statement(
        VOCAB
        + ASKED
        + vectors("corpus", "id")
        + term_rows("asked", "asked", "id")
        + vectors("asked", "id")
        + cosines("asked_vec", "corpus_vec", "asked", "corpus", "term", "w")
        + best(5),
        f"SELECT query_id, rank, id, {r6('score')} AS score FROM best",
    ),
    "match_lite_documents": statement(matched_lite(ASKED), SHOWN),
    "matches_envelope": statement(matched_lite(ASKED), SHOWN),
    "index_by_key": statement(matched_lite(ASKED), SHOWN),
    "index_grown": statement(matched_lite(ASKED), SHOWN),
    "match_benchmark": statement(matched(), SHOWN),
    "index_roundtrip": statement(matched(), SHOWN),
    "match_streamed": statement(
        matched_lite(
            [
                (
                    "asked",
                    f"SELECT conv_id || '-' || turn AS id, {clean('text')} AS text FROM "
                    "conversations",
                )
            ]
        ),
        SHOWN,
    ),
    "match_profiles": statement(
        matched_lite(
            [
                (
                    "asked",
                    f"SELECT DISTINCT {clean(chr(39).join(['p_name || ', ' ', ' || p_type']))} "
                    "AS id, "
                    f"{clean(chr(39).join(['p_name || ', ' ', ' || p_type']))} AS text FROM part",
                )
            ],
            PREPARED
            + [("corpus", "SELECT person_id AS id, title, embedding_text AS text FROM prepared")]
            + VOCAB[1:],
        ),
        SHOWN,
    ),
    "ndcg_at_k": one_metric("ndcg", True),
    "precision_at_k": one_metric("precision", True),
    "recall_at_k": one_metric("recall", True),
    "mrr": one_metric("mrr", False),
    "map_score": one_metric("map", False),
    "ari": one_metric("ari", False),
    "nmi": one_metric("nmi", False),
    "purity": one_metric("purity", False),
    "source_metrics": statement(
        BY_SOURCE + scored_metrics((1.0, 2.0)),
        f"SELECT query_id, metric, k, threshold, {r6('value')} AS value, valid FROM metrics",
    ),
    "evaluate_all": statement(
        MANY, f"SELECT metric, k, threshold, {r6('value')} AS value, queries FROM means"
    ),
    "metric_series": statement(
        ONE,
        "SELECT k, "
        + ", ".join(
            f"{r6(f'max(value) FILTER (WHERE metric = {lit(m)})')} AS {m}"
            for m in ("ndcg", "precision", "recall")
        )
        + " FROM means WHERE k IS NOT NULL GROUP BY k",
    ),
    "metric_bars": statement(
        ONE, f"SELECT metric, {r6('value')} AS value FROM means WHERE k IS NULL"
    ),
    "evaluation_report": statement(
        ONE,
        "SELECT CASE WHEN k IS NULL THEN metric ELSE metric || '@' || k END AS name, "
        "printf('%.4f', value) AS average, queries FROM means",
    ),
    "best_threshold": statement(
        MANY + f1_rows(),
        f"SELECT threshold, {r6('f1')} AS f1, {r6('precision')} AS precision, {r6('recall')} "
        "AS recall FROM chosen",
    ),
    "title_mapping": statement(PART_ITEMS, "SELECT * FROM mapping"),
    "word_overlap_match": statement(
        PART_ITEMS
        + [
            (
                "asked_titles",
                "SELECT DISTINCT p_type || ' ' || p_name AS title FROM part UNION SELECT "
                "p_brand FROM part",
            )
        ]
        + overlaps("asked_titles", "mapping"),
        "SELECT title, item_id, overlap FROM overlap",
    ),
    "word_overlap_scores": (
        "SELECT p_partkey, "
        + ", ".join(
            f"len(list_intersect({words_of(chr(39).join(['p_type || ', ' ', ' || p_name']))}, "
            f"{words_of(c)}))::INT AS {n}"
            for c, n in (("p_name", "with_name"), ("p_type", "with_type"))
        )
        + " FROM part"
    ),
    "sampled_truth": statement(SAMPLED, "SELECT * FROM sampled"),
    "evaluated_model": evaluated(),
    "scan_summary_rows": statement(
        matched(),
        "SELECT query_id AS cv_file, rank, title AS match_title, similarity_percentage AS "
        "similarity, substr(embedding_text, 1, 200) AS match_details FROM shown",
    ),
    "overall_summary_row": statement(matched(), SUMMARY),
    "overall_summary_lines": statement(
        matched() + [("s", SUMMARY)],
        "SELECT 0 AS line_no, 'Total CVs processed: ' || total_cvs AS line FROM s "
        + " ".join(
            f"UNION ALL SELECT {i}, '{label}: ' || printf('%.2f', {c}) || '%' FROM s"
            for i, (c, label) in enumerate(
                [
                    ("average_similarity", "Average similarity score"),
                    ("highest_avg_similarity", "Highest average CV similarity"),
                    ("lowest_avg_similarity", "Lowest average CV similarity"),
                    ("highest_individual_match", "Highest individual match"),
                    ("lowest_individual_match", "Lowest individual match"),
                    ("standard_deviation", "Standard deviation"),
                ],
                1,
            )
        ),
    ),
    "comparison": statement(
        matched()
        + [
            (
                "per_doc",
                "SELECT query_id AS document, avg(similarity_percentage) AS a FROM shown "
                "GROUP BY query_id",
            )
        ],
        f"SELECT document, {r6('a')} AS avg_similarity, {r6('avg(a) OVER ()')} AS "
        "overall_average FROM per_doc",
    ),
    "match_lines": statement(
        matched(),
        "SELECT query_id, rank, title || ' - ' || printf('%.2f', similarity_percentage) || "
        f"'%' AS heading, {cut('embedding_text', 100)} AS description FROM shown",
    ),
    "json_roundtrip": statement(
        matched(), "SELECT query_id, rank, id, title, similarity_percentage FROM shown"
    ),
    "extract_pages": statement(
        PAGE_TEXT,
        "SELECT f.path[7:] AS name, regexp_replace(f.path[7:], '[.][^.]*$', '') AS stem, "
        "length(text) AS n_chars, substr(md5(text), 1, 8) AS text_hash, CASE WHEN text IS NULL "
        "THEN 'Unsupported file format: .txt' END AS error FROM files f LEFT JOIN page_texts t "
        "ON t.path = f.path",
    ),
    "scan_pages": statement(
        PAGE_TEXT
        + matched_lite([("asked", "SELECT path[7:] AS id, text FROM page_texts")]),
        "SELECT f.path[7:] AS cv_file, CASE WHEN f.path LIKE '%.txt' THEN "
        "'Unsupported file format: .txt' END AS error, rank, title AS match_title, "
        "similarity_percentage AS similarity FROM files f LEFT JOIN shown ON query_id = f.path[7:]",
    ),
    "files_streamed": statement(
        [
            (
                "files",
                "SELECT 'i' || item_id || CASE WHEN item_id % 2 = 0 THEN '.doc' ELSE '.txt' END AS "
                f"name, {clean('text')} AS text FROM benchmark",
            )
        ]
        + matched_lite([("asked", "SELECT name AS id, text FROM files WHERE name LIKE '%.doc'")]),
        "SELECT name AS cv_file, CASE WHEN name LIKE '%.txt' THEN "
        "'Unsupported file format: .txt' END AS error, rank, title AS match_title, "
        "similarity_percentage AS similarity FROM files LEFT JOIN shown ON query_id = name",
    ),
    "file_kinds": statement(
        PAGE_FILES,
        r"SELECT lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext, count(*) AS files, "
        f"{r6('sum(octet_length(encode(html))) / (1024.0::DOUBLE * 1024.0::DOUBLE)')} AS "
        "size_mb FROM files GROUP BY ext",
    ),
    "path_parts": (
        r"SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem, "
        r"lower(regexp_extract(url, '[^/](\.[^./]*)$', 1)) AS ext FROM pages"
    ),
    "ground_truth_load": (
        "SELECT source AS query_id, doc_id::VARCHAR AS item_id, (quality + toxic)::DOUBLE AS "
        "relevance FROM labels JOIN documents USING (doc_id)"
    ),
    "corpus_prints": statement(
        CORPUS
        + [
            (
                "h",
                "SELECT ('0x' || substr(md5(concat_ws(chr(31), coalesce('=' || text, '~'), "
                "coalesce('=' || id, '~'), coalesce('=' || title, '~'))), 1, 15))::BIGINT AS h "
                "FROM corpus",
            )
        ],
        "SELECT count(*) AS n_rows, bit_xor(h) AS hash_xor, sum(h % 1000003)::BIGINT AS hash_sum "
        "FROM h",
    ),
    "artifact_inventory": (
        "SELECT artifact, ext FROM (VALUES ('corpus', '.parquet'), ('vocab', '.parquet'), "
        "('vectors', '.parquet'), ('vectors_meta', '.json'), ('embeddings', '.parquet'), "
        "('embeddings_meta', '.json'), ('settings', '.parquet'), ('fingerprint', '.parquet')) "
        "x(artifact, ext) WHERE (SELECT count(*) FROM documents) > 0"
    ),
    "newest_artifact": (
        "SELECT 'tfidf_enhanced_b' AS artifact, item_id, md5(text) AS text_md5 FROM benchmark"
    ),
    "batch_summary_written": statement(
        matched(),
        "SELECT query_id AS cv_file, rank, title AS match_title, similarity_percentage AS "
        "similarity, substr(embedding_text, 1, 200) AS match_details FROM shown",
    ),
    "overall_summary_written": statement(matched(), SUMMARY),
    "report_envelope": statement(matched(), SUMMARY),
    "metrics_written": statement(
        ONE, f"SELECT metric, k, threshold, {r6('value')} AS value, queries FROM means"
    ),
    "threshold_written": statement(
        MANY + f1_rows(),
        f"SELECT threshold, {r6('f1')} AS f1, {r6('precision')} AS precision, {r6('recall')} "
        "AS recall FROM chosen",
    ),
    "csv_line_breaks": "SELECT doc_id, md5(text) AS text_md5, source FROM documents",
    "processed_corpus_load": statement(PREPARED, PREPARED_FINAL),
    "capped_profiles": statement(
        PROFILES,
        "SELECT * FROM profiles WHERE person_id <= (SELECT floor(avg(c_custkey)) FROM customer)",
    ),
    "fallback_extraction": statement(
        PAGE_TEXT,
        "SELECT f.path[7:] AS name, regexp_replace(f.path[7:], '[.][^.]*$', '') AS stem, "
        "length(text) AS n_chars, substr(md5(text), 1, 8) AS text_hash, CASE WHEN text IS NULL "
        "THEN 'Unsupported file format: .txt' END AS error FROM files f LEFT JOIN page_texts t "
        "ON t.path = f.path",
    ),
    "folder_scan": (
        "SELECT 'i' || item_id || ['doc', 'txt'][item_id % 2 + 1] AS name, "
        "md5(text || chr(10)) AS content_md5 FROM benchmark"
    ),
    "inline_texts": statement(
        matched_lite(
            [
                (
                    "asked",
                    f"SELECT id, {clean('text')} AS text FROM (VALUES "
                    + ", ".join(f"({lit(i)}, {lit(t)})" for i, t in INLINE_TEXTS.items())
                    + f") given(id, text) UNION ALL SELECT 'b' || item_id AS id, {clean('text')} AS "
                    "text FROM benchmark",
                )
            ]
        ),
        SHOWN,
    ),
    "user_encoder": statement(
        CORPUS
        + [
            (
                "cells",
                "SELECT id, pos, (1 + length(text) - length(replace(text, letter, '')))::DOUBLE "
                "AS v FROM corpus, (SELECT unnest(range(0, 8)) AS pos, "
                "unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS letter)",
            )
        ],
        "SELECT id, pos, round((v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 4) "
        "AS value FROM cells",
    ),
    "unchunked_embedding": statement(
        VOCAB
        + vectors("corpus", "id")
        + boost("corpus", "corpus")
        + [("corpus_chunks", "SELECT id, 0 AS chunk_idx, text AS chunk FROM corpus_boosted")]
        + embeddings("corpus"),
        f"SELECT id, pos, {r6('value')} AS value FROM corpus_emb WHERE {r6('value')} <> 0",
    ),
}
