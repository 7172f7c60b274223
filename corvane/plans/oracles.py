"""DuckDB SQL with the same rows as the registered queries.

Statements are put together from common table expressions: entities, their
normal forms, keys, candidates and scores.  Rule tables and word lists are the
fixed values of ``vocab``; all logic is SQL of its own.
"""

from __future__ import annotations

import re

from corvane.functions import vocab
from corvane.plans.views import DOCUMENT_SQL, ENTITY_SQL, LOST, TRUTH_SQL


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in values.items()) + "}"


def _alt(values: list[str]) -> str:
    return "|".join(values)


def _steps(source: str, steps: list[str], name: str = "t") -> str:
    """Nested selects that rewrite the column ``name`` step by step."""
    out = source
    for step in steps:
        out = f"SELECT * REPLACE ({step} AS {name}) FROM ({out})"
    return out


def _re(pattern: str, into: str, column: str = "t") -> str:
    return f"regexp_replace({column}, {_q(pattern)}, {_q(into)}, 'g')"


def _rules(listed: list[tuple[str, str, str]]) -> list[str]:
    return [f"CASE WHEN contains(t, {_q(k)}) THEN {_re(p, f' {r} ')} ELSE t END" for k, p, r in listed]


def _words(column: str) -> str:
    return f"[x FOR x IN string_split({column}, ' ') IF x <> '']"


_WS = " \t\n\r"
_NULL = "lower({0}) IN ('nan', 'none', 'null', '')"

NAME_STEPS = [
    "strip_accents(trim(t))",
    f"lower(trim({_re('^[-' + chr(92) + 's><#*/+]+', '')}))",
    _re(r"^the\s+", ""),
    _re(r"([a-z])0([a-z])", r"\1o\2"),
    _re(r"([a-z])0([a-z])", r"\1o\2"),
    _re(r"([a-z])1([a-z])", r"\1l\2"),
    _re(r"([a-z])1([a-z])", r"\1l\2"),
    _re(r"^\s*m\s*/\s*s\s+", ""),
    _re(r"^\s*m\s*\.\s*s\s*\.?\s+", ""),
    _re(vocab.DOMAIN_SUFFIX, ""),
    _re(r"^www\.", ""),
    _re(r"\s*&\s*", " and "),
    *_rules(vocab.LEGAL_FORMS),
    _re(r"[^\p{L}\p{N}_\s]", " "),
    f"trim({_re(chr(92) + 's+', ' ')})",
]
ADDRESS_STEPS = [
    "lower(strip_accents(trim(t)))",
    _re(r"#\s*", ""),
    _re(r"\bno\.?\s*(\d)", r"\1"),
    *_rules(vocab.STREETS + vocab.UNITS + vocab.STATES),
    _re(r"\b1/2\b", ""),
    _re(r"\b0+(\d+)\b", r"\1"),
    _re(r"[^\p{L}\p{N}_\s\-/]", " "),
    f"trim({_re(chr(92) + 's+', ' ')})",
]


def _core_steps() -> list[str]:
    longest = lambda a: f"list_reduce(regexp_split_to_array(t, {_q(chr(92) + 'b' + a + chr(92) + 'b')}), lambda p, q: CASE WHEN length(q) > length(p) THEN q ELSE p END)"
    cases = " ".join(f"WHEN regexp_matches(t, {_q(chr(92) + 'b' + a + chr(92) + 'b')}) THEN trim({longest(a)})" for a in vocab.ALIASES)
    legal = _alt(vocab.LEGAL_WORDS)
    return [f"CASE {cases} ELSE t END", f"trim({_re(f'( (?:{legal}))+$', '', chr(39) + ' ' + chr(39) + ' || t')})", f"trim({_re(f'^(?:(?:{legal}) )+', '', 't || ' + chr(39) + ' ' + chr(39))})"]


def _side(source: str, stop: list[str], building: str, more: str = "") -> str:
    """Comparison fields of normalised rows."""
    bare = "trim(x, '#,./ -')"
    return f"""SELECT entity_id, source, business_name, business_address, norm_name, core_name, norm_addr, norm_country, nw, cw, aw, list_distinct(cw) AS cs, list_distinct(aw) AS as_, {building} AS building,
      list_distinct([x FOR x IN aw IF length(x) >= 4 AND regexp_full_match(x, '[a-z]+') AND NOT list_contains({_list(stop)}, x)]) AS loc,
      list_distinct([CASE WHEN regexp_full_match({bare}, '\\d+') THEN {bare} ELSE regexp_replace({bare}, '[-/]', '', 'g') END FOR x IN aw IF regexp_full_match({bare}, '\\d+') OR (regexp_matches(x, '[-/]') AND regexp_matches(x, '\\d'))]) AS num,
      replace(norm_name, ' ', '') AS pn, replace(norm_addr, ' ', '') AS pa{more} FROM {source}"""


def _grams(source: str) -> str:
    def of(text: str, n: int) -> str:
        return f"CASE WHEN {text} = '' THEN [] WHEN length({text}) < {n} THEN [{text}] ELSE list_distinct([substr({text}, i, {n}) FOR i IN range(1, length({text}) - {n - 2})]) END"

    return f"SELECT *, {of('pn', 3)} AS n3, {of('pn', 4)} AS n4, {of('pa', 3)} AS a3 FROM {source}"


def _common(x: str, y: str) -> str:
    """Length of the longest common subsequence: one bit of a wide integer for each character of ``x``."""
    whole = f"((1::HUGEINT << length({x})) - 1)"
    places = f"list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN substr({x}, i, 1) = c THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))::HUGEINT"
    return f"(CASE WHEN {x} = '' OR {y} = '' THEN 0 ELSE length({x}) - bit_count(list_reduce(list_prepend({whole}, list_transform(string_split({y}, ''), lambda c: {places})), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {whole})) END)"


def _words_cte(pairs: str) -> str:
    """Sorted words, and the shared and own ones of both sides, as texts."""
    text = lambda words: f"array_to_string(list_sort({words}), ' ')"
    own = lambda x, y: text(f"[w FOR w IN list_distinct({x}) IF NOT list_contains({y}, w)]")
    sets = ", ".join(f"{text(f'list_intersect(list_distinct(a.{c}), list_distinct(b.{c}))')} AS {c}_both, {own(f'a.{c}', f'b.{c}')} AS {c}_a, {own(f'b.{c}', f'a.{c}')} AS {c}_b" for c in ("nw", "aw"))
    return f"SELECT source1_id, candidate_id, {text('a.nw')} AS sa, {text('b.nw')} AS sb, {sets} FROM {pairs}"


def _ratio_cte(words: str) -> str:
    def of_sets(c: str) -> str:
        both, x, y = f"{c}_both", f"{c}_a", f"{c}_b"
        lead = f"CASE WHEN {both} = '' THEN 0 ELSE length({both}) + 1 END"
        shared = lambda z: f"CASE WHEN {both} = '' THEN 0.0 ELSE 2.0::DOUBLE * length({both}) / (2 * length({both}) + 1 + length({z})) END"
        whole = f"2.0::DOUBLE * ({lead} + {_common(x, y)}) / (2 * ({lead}) + length({x}) + length({y}))"
        return f"CASE WHEN {both} || {x} = '' OR {both} || {y} = '' THEN 0.0 WHEN {x} = '' OR {y} = '' THEN 1.0 ELSE greatest({whole}, {shared(x)}, {shared(y)}) END::DOUBLE"

    sort = f"CASE WHEN sa = '' OR sb = '' THEN 0.0 ELSE 2.0::DOUBLE * {_common('sa', 'sb')} / (length(sa) + length(sb)) END::DOUBLE"
    return f"SELECT source1_id, candidate_id, {sort} AS name_token_sort_ratio, {of_sets('nw')} AS name_token_set_ratio, {of_sets('aw')} AS address_token_set_ratio FROM {words}"


_COUNTRY = f"CASE WHEN {_NULL.format('country')} THEN 'UNKNOWN' ELSE coalesce({_map(vocab.COUNTRIES)}[lower(trim(country))], trim(country)) END"

_ENHANCED_NULL = "lower(trim({0})) IN ('nan', 'none', 'null', '', '<na>')"
_LEGAL_C = _alt(vocab.LEGAL_WORDS_ENHANCED)

CTES: dict[str, tuple[list[str], str]] = {
    "ent": ([], ENTITY_SQL),
    "tl": ([], TRUTH_SQL),
    "truth": (["tl"], "SELECT DISTINCT source1_entity_id AS source1_id, trim(x) AS candidate_id FROM (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS x FROM tl) WHERE trim(x) <> ''"),
    "nn": (["ent"], f"SELECT entity_id, CASE WHEN {_NULL.format('business_name')} THEN '' ELSE t END AS norm_name FROM ({_steps('SELECT entity_id, business_name, business_name AS t FROM ent', NAME_STEPS)})"),
    "na": (["ent"], f"SELECT entity_id, CASE WHEN {_NULL.format('business_address')} THEN '' ELSE t END AS norm_addr FROM ({_steps('SELECT entity_id, business_address, business_address AS t FROM ent', ADDRESS_STEPS)})"),
    "cn": (["nn"], f"SELECT entity_id, CASE WHEN t = '' THEN norm_name ELSE t END AS core_name FROM ({_steps('SELECT entity_id, norm_name, norm_name AS t FROM nn', _core_steps())})"),
    "nrm": (["ent", "nn", "na", "cn"], f"SELECT ent.*, norm_name, norm_addr, core_name, {_COUNTRY} AS norm_country FROM ent JOIN nn USING (entity_id) JOIN na USING (entity_id) JOIN cn USING (entity_id)"),
    # variant C
    "nrmc": (
        ["ent"],
        f"""SELECT *, regexp_replace(regexp_replace(norm_name, '^(\\S+(?: \\S+)*?)(?: (?:{_LEGAL_C}))+$', '\\1'), '^(?:the|a|an) (.)', '\\1') AS core_name FROM (
          SELECT *, CASE WHEN {_ENHANCED_NULL.format('business_name')} THEN '' ELSE trim(regexp_replace(regexp_replace(replace(lower(strip_accents(business_name)), '&', ' and '), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) END AS norm_name,
            CASE WHEN {_ENHANCED_NULL.format('business_address')} THEN '' ELSE array_to_string([y FOR y IN [coalesce({_map(vocab.ABBREVIATIONS)}[trim(x, ' ,./-')], trim(x, ' ,./-')) FOR x IN string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(business_address)), '[#,.]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')] IF y <> ''], ' ') END AS norm_addr,
            CASE WHEN {_ENHANCED_NULL.format('country')} THEN 'UNKNOWN' ELSE coalesce({_map(vocab.COUNTRIES_ENHANCED)}[lower(trim(country))], upper(trim(country))) END AS norm_country
          FROM ent)""",
    ),
    "post": (
        ["nrmc"],
        """SELECT *, coalesce(CASE WHEN upper(norm_country) IN ('INDIA', 'IN') THEN [x FOR x IN bare IF regexp_full_match(x, '[1-9]\\d{5}')][-1]
             WHEN upper(norm_country) IN ('US', 'USA', 'FRANCE', 'FR') THEN [x FOR x IN bare IF regexp_full_match(x, '\\d{5}')][-1] END, [x FOR x IN bare IF regexp_full_match(x, '\\d{5,6}')][-1], '') AS postal
           FROM (SELECT *, [trim(x, '#,./ -') FOR x IN string_split(norm_addr, ' ') IF x <> ''] AS bare FROM nrmc)""",
    ),
    # arrays that keys and features read
    "arr": (
        ["nrm"],
        f"""SELECT *, replace(core_name, ' ', '') AS compact, {_words('core_name')} AS cw, {_words('norm_addr')} AS aw, {_words('norm_name')} AS nw FROM nrm""",
    ),
    "akey": (
        ["arr"],
        f"""SELECT entity_id, CASE WHEN num IS NULL THEN '' WHEN street IS NULL THEN num ELSE num || '_' || street END AS address_key FROM (
          SELECT entity_id, tl[p] AS num, [x FOR x IN tl[p + 1:] IF length(regexp_replace(x, '[-/]', '', 'g')) >= 3 AND NOT list_contains({_list(vocab.ADDRESS_KEY_STOP)}, regexp_replace(x, '[-/]', '', 'g'))][1] AS street
          FROM (SELECT entity_id, tl, coalesce(list_position([regexp_matches(x, '\\d') FOR x IN tl], true), 0) AS p
                FROM (SELECT entity_id, [x FOR x IN aw IF NOT list_contains({_list(vocab.ADDRESS_KEY_STOP)}, x)] AS tl FROM arr)) WHERE true)""",
    ),
    "codes": (
        ["arr"],
        """SELECT entity_id, compact, w, p, regexp_matches(p, '\\d') AND regexp_matches(p, '[a-z]') AND length(p) BETWEEN 3 AND 8 AS is_unit, contains(w, '/') AND regexp_matches(w, '\\d') AND length(w) <= 8 AS is_plot
           FROM (SELECT entity_id, compact, w, regexp_replace(w, '[-/]', '', 'g') AS p FROM (SELECT entity_id, compact, unnest(aw) AS w FROM arr)) WHERE NOT regexp_full_match(p, '\\d+(st|nd|rd|th)')""",
    ),
    "sig": (["arr"], f"SELECT entity_id, cw, compact, [x FOR x IN cw IF length(x) >= 3 AND NOT list_contains({_list(vocab.GENERIC_TERMS)}, x)] AS s, [x FOR x IN aw IF length(x) >= 4 AND regexp_full_match(x, '[a-z]+') AND NOT list_contains({_list(vocab.LOCALITY_KEY_STOP)}, x)] AS l FROM arr"),
    "k0": (
        ["sig", "codes", "akey"],
        f"""SELECT entity_id, 'NP4' AS type, substr(compact, 1, 4) AS value FROM sig WHERE length(compact) >= 4
            UNION SELECT entity_id, 'NP6', substr(compact, 1, 6) FROM sig WHERE length(compact) >= 6
            UNION SELECT entity_id, 'NCOMP', compact FROM sig WHERE length(compact) >= 5
            UNION SELECT entity_id, 'TOK', x FROM (SELECT entity_id, unnest(s) AS x FROM sig) WHERE length(x) >= 4
            UNION SELECT entity_id, 'TOK3', x FROM (SELECT entity_id, unnest(s) AS x FROM sig) WHERE regexp_full_match(x, '[a-z]{{3}}') AND x NOT IN ('and', 'the', 'for', 'all')
            UNION SELECT entity_id, 'NSORT', array_to_string(list_sort(s[1:4]), '_') FROM sig WHERE len(s) >= 2
            UNION SELECT entity_id, 'ADDR', address_key FROM akey WHERE length(address_key) >= 3
            UNION SELECT entity_id, 'UNIT', p FROM codes WHERE is_unit
            UNION SELECT entity_id, 'PLOT', w FROM codes WHERE NOT is_unit AND is_plot
            UNION SELECT entity_id, 'POSTAL', w || '_' || substr(compact, 1, 3) FROM codes WHERE NOT is_unit AND NOT is_plot AND regexp_full_match(w, '\\d{{5,6}}') AND length(compact) >= 3
            UNION SELECT entity_id, 'ADDR_LOC', l[1] || '_' || l[2] FROM sig WHERE len(l) >= 2""",
    ),
    "keys": (["k0", "nrm"], "SELECT norm_country AS country, type, value, entity_id, source FROM k0 JOIN nrm USING (entity_id)"),
    "sizes": (["keys"], "SELECT country, type, value, count(*) AS size FROM keys WHERE source <> 1 GROUP BY ALL"),
    "shared": (["keys", "sizes"], "SELECT q.entity_id AS source1_id, t.entity_id AS candidate_id, 'source' || t.source AS candidate_source, q.type, size FROM keys q JOIN keys t USING (country, type, value) JOIN sizes USING (country, type, value) WHERE q.source = 1 AND t.source <> 1"),
    "wpairs": (["shared"], "SELECT source1_id, candidate_id, candidate_source, sum(CASE type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in vocab.KEY_WEIGHTS.items()) + " ELSE 1.0 END)::DOUBLE AS blocking_score FROM shared WHERE size <= 1000 GROUP BY ALL"),
    "cpairs": (["shared"], "SELECT source1_id, candidate_id, candidate_source, count(*)::DOUBLE AS blocking_score FROM shared WHERE size <= 1000 GROUP BY ALL"),
    "wall": (["wpairs"], "SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY blocking_score DESC, candidate_id)::DOUBLE AS blocking_rank, blocking_score / max(blocking_score) OVER (PARTITION BY source1_id) AS blocking_score_ratio FROM wpairs"),
    "call": (["cpairs"], "SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY blocking_score DESC, candidate_id)::DOUBLE AS blocking_rank, blocking_score / max(blocking_score) OVER (PARTITION BY source1_id) AS blocking_score_ratio FROM cpairs"),
    "cand": (["wall"], "SELECT * FROM wall WHERE blocking_rank <= 20"),
    "req": (["ent"], "SELECT entity_id AS source1_id FROM ent WHERE source = 1"),
    # comparison fields
    "side": (["arr"], _side("arr", vocab.LOCALITY_STOP, "coalesce([x FOR x IN [regexp_replace(trim(y, '#,./ -'), '[-/]', '', 'g') FOR y IN aw] IF regexp_full_match(x, '\\d{1,6}')][1], '')")),
    "grams": (["side"], _grams("side")),
    "pair": (["cand", "grams"], "SELECT c.*, a, b FROM cand c JOIN grams a ON a.entity_id = c.source1_id JOIN grams b ON b.entity_id = c.candidate_id"),
    "texts": (["pair"], _words_cte("pair")),
    "ratio": (["texts"], _ratio_cte("texts")),
}


def _lev(x: str, y: str) -> str:
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END"


def _jac(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"


def _over(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) END"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


def _contains(x: str, y: str) -> str:
    return _flag(f"{x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x}))")


CTES |= {
    "scored": (
        ["pair"],
        f"""SELECT *, 0.5::DOUBLE * nl + 0.5::DOUBLE * al AS probability FROM (SELECT source1_id, candidate_id, candidate_source, blocking_rank, {_lev('a.norm_name', 'b.norm_name')} AS nl, {_lev('a.norm_addr', 'b.norm_addr')} AS al,
             a.norm_name AS norm_a, b.norm_name AS norm_b, a.core_name AS core_a, b.core_name AS core_b, a.building AS building_a, b.building AS building_b, a.norm_country AS norm_country FROM pair)""",
    ),
    "lab": (["scored", "truth"], "SELECT scored.*, CASE WHEN truth.source1_id IS NULL THEN 0 ELSE 1 END AS label FROM scored LEFT JOIN truth USING (source1_id, candidate_id)"),
    "passing": (["scored"], "SELECT * FROM scored WHERE probability >= 0.6"),
    "counts": (
        ["req", "passing", "truth"],
        """SELECT source1_id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM req
           LEFT JOIN (SELECT source1_id, count(*) AS n_true FROM truth GROUP BY 1) USING (source1_id)
           LEFT JOIN (SELECT p.source1_id, count(*) AS n_pred, count(t.source1_id) AS tp FROM passing p LEFT JOIN truth t USING (source1_id, candidate_id) GROUP BY 1) USING (source1_id)""",
    ),
}


def _prf(source: str) -> str:
    inner = f"SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 THEN 0.0 ELSE tp::DOUBLE / n_pred END AS p, CASE WHEN n_true = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp::DOUBLE / n_true END AS r FROM {source}"
    return f"SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 OR p <= 0 OR r <= 0 THEN 0.0 ELSE 1.25 * p * r / (0.25 * p + r) END AS f FROM ({inner})"


def _summary(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    mean = lambda c: f"sum(({c})::DECIMAL(20, 14))::DOUBLE / count({c})"
    inner = f"""SELECT {lead}{mean("f")} AS f, {mean("p")} AS p, {mean("r")} AS r, {mean("CASE WHEN n_true > 0 THEN f END")} AS nf, count(*) AS total_evaluated_s1, count(*) FILTER (n_true = 0) AS true_singletons, count(*) FILTER (n_true = 0 AND n_pred = 0) AS correct_singletons,
      sum(tp)::BIGINT AS total_tp_pairs, sum(n_pred - tp)::BIGINT AS total_fp_pairs, sum(n_true - tp)::BIGINT AS total_fn_pairs FROM ({_prf(source)}) {group}"""
    mid = f"SELECT *, CASE WHEN total_tp_pairs + total_fp_pairs = 0 THEN 0 ELSE total_tp_pairs::DOUBLE / (total_tp_pairs + total_fp_pairs) END AS mp, CASE WHEN total_tp_pairs + total_fn_pairs = 0 THEN 0 ELSE total_tp_pairs::DOUBLE / (total_tp_pairs + total_fn_pairs) END AS mr FROM ({inner})"
    return f"""SELECT {lead}round(f, 4) AS macro_f05, round(p, 4) AS macro_precision, round(r, 4) AS macro_recall, CASE WHEN true_singletons = 0 THEN 1.0 ELSE round(correct_singletons::DOUBLE / true_singletons, 4) END AS singleton_accuracy,
      round(coalesce(nf, 0), 4) AS non_singleton_macro_f05, round(mp, 4) AS micro_precision, round(mr, 4) AS micro_recall, CASE WHEN mp <= 0 OR mr <= 0 THEN 0.0 ELSE round(1.25 * mp * mr / (0.25 * mp + mr), 4) END AS micro_f05,
      total_evaluated_s1, true_singletons, correct_singletons, true_singletons - correct_singletons AS false_merges_on_singletons, total_tp_pairs, total_fp_pairs, total_fn_pairs FROM ({mid})"""


def _half_up(sql: str) -> str:
    """Rounds on decimals: DuckDB rounds a binary double just under one half down, Spark its decimal text up."""
    out, at = [], 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, begin + 6, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        out.append(f"{sql[at:begin]}round(({_half_up(sql[begin + 6 : comma])})::DECIMAL(30, 14){sql[comma:end]}::DOUBLE")
        at = end
    return "".join(out) + sql[at:]


def _statement(needs: list[str], body: str, own: dict[str, str] | None = None) -> str:
    """``body`` after the common table expressions that it needs, in order of need; ``own`` ones replace those of their name."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    own = own or {}
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({own.get(n, CTES[n][1])})" for n in order) + "\n" + _half_up(body)


def _counts_over(grid: str, by: str, condition: str, extra: str = "") -> str:
    """entity counts for each row of a parameter grid."""
    return f"""(WITH g AS (SELECT * FROM {grid}), hit AS (SELECT DISTINCT {by}, source1_id, candidate_id FROM (SELECT {by}, scored.*, max(probability) OVER (PARTITION BY {by}, source1_id) AS best FROM scored, g WHERE {condition}) {extra})
      SELECT {by}, source1_id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM req CROSS JOIN g
      LEFT JOIN (SELECT source1_id, count(*) AS n_true FROM truth GROUP BY 1) USING (source1_id)
      LEFT JOIN (SELECT {by}, hit.source1_id, count(*) AS n_pred, count(t.source1_id) AS tp FROM hit LEFT JOIN truth t USING (source1_id, candidate_id) GROUP BY ALL) USING (source1_id, {by}))"""


def _values(name: str, values: list[float]) -> str:
    return f"(SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS {name})"


_MACRO = _counts_over(_values("threshold", vocab.MACRO_THRESHOLDS), "threshold", "probability >= threshold")
_CONFUSION = "count(*) FILTER (label = 1 AND probability >= {t}) AS tp, count(*) FILTER (label = 0 AND probability >= {t}) AS fp, count(*) FILTER (label = 1 AND probability < {t}) AS fn, count(*) FILTER (label = 0 AND probability < {t}) AS tn"


def _pair_metrics(inner: str, lead: str = "") -> str:
    mid = f"SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM ({inner})"
    return f"SELECT {lead}round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p <= 0 OR r <= 0 THEN 0.0 ELSE round(1.25 * p * r / (0.25 * p + r), 6) END AS f05, CASE WHEN p <= 0 OR r <= 0 THEN 0.0 ELSE round(2.0 * p * r / (p + r), 6) END AS f1, tp, fp, fn"


_POINT = _pair_metrics(f"SELECT {_CONFUSION.format(t=0.75)} FROM lab") + f", tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM (SELECT {_CONFUSION.format(t=0.75)} FROM lab))"
_SWEEP_INNER = f"SELECT threshold, {_CONFUSION.format(t='threshold')} FROM lab, {_values('threshold', vocab.PAIR_THRESHOLDS)} GROUP BY threshold"
_SWEEP = _pair_metrics("", "threshold, ") + f", tn FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM ({_SWEEP_INNER}))"

_DIFF = lambda x, y, words: f"(len(list_intersect(string_split({x}, ' '), {_list(words)})) > 0 AND len(list_intersect(string_split({y}, ' '), {_list(words)})) > 0 AND list_sort(list_distinct(list_intersect(string_split({x}, ' '), {_list(words)}))) <> list_sort(list_distinct(list_intersect(string_split({y}, ' '), {_list(words)}))))"
_BASE_T = "CASE norm_country WHEN 'US' THEN 0.78::DOUBLE WHEN 'India' THEN 0.76::DOUBLE ELSE 0.75::DOUBLE END"
_RANK_T = f"{_BASE_T} + CASE WHEN blocking_rank <= 3 THEN 0.0::DOUBLE WHEN blocking_rank <= 6 THEN 0.03::DOUBLE WHEN blocking_rank <= 10 THEN 0.06::DOUBLE ELSE 0.09::DOUBLE END"
_IDS = "SELECT source1_id, candidate_id FROM"
_NARROW = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY blocking_score DESC, candidate_id) AS rk FROM (SELECT source1_id, candidate_id, sum(CASE type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in vocab.KEY_WEIGHTS.items()) + " ELSE 1.0 END) AS blocking_score FROM shared WHERE size <= 3 GROUP BY ALL)) WHERE rk <= 2)"
_LISTS = "SELECT source1_id, coalesce(string_agg(candidate_id, ',' ORDER BY probability DESC, candidate_id), '') AS matches FROM req LEFT JOIN passing USING (source1_id) GROUP BY source1_id"

ORACLE_SQL: dict[str, str] = {
    "true_pairs": _statement(["truth"], "SELECT * FROM truth"),
    "na_policy": f"SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN list_contains({_list(vocab.NA_TOKENS)}, ({_list(vocab.NA_TOKENS)})[p_partkey % {len(vocab.NA_TOKENS)} + 1]) THEN '' END AS business_name FROM part",
    "semi_scan": _statement(["ent", "truth"], "SELECT entity_id, business_name FROM ent WHERE entity_id IN (SELECT candidate_id FROM truth)"),
    "benchmark_set": _statement(["tl"], "SELECT source1_entity_id, row FROM (SELECT *, row_number() OVER (PARTITION BY trim(matched_entity_ids) = '' ORDER BY row) AS k FROM (SELECT *, CAST(substr(source1_entity_id, 4) AS BIGINT) AS row FROM tl ORDER BY row LIMIT 20000)) WHERE k <= CASE WHEN trim(matched_entity_ids) = '' THEN 280 ELSE 4720 END"),
    "norm_country": _statement(["ent"], f"SELECT entity_id, {_COUNTRY} AS norm_country FROM ent"),
    "norm_name": _statement(["nn"], "SELECT * FROM nn"),
    "clean_core_name": _statement(["cn"], "SELECT * FROM cn"),
    "norm_address": _statement(["na"], "SELECT * FROM na"),
    "address_key": _statement(["akey"], "SELECT * FROM akey"),
    "norm_country_upper": _statement(["nrmc"], "SELECT entity_id, norm_country FROM nrmc"),
    "norm_name_enhanced": _statement(["nrmc"], "SELECT entity_id, norm_name, core_name FROM nrmc"),
    "expand_abbrev": _statement(["nrmc"], "SELECT entity_id, norm_addr FROM nrmc"),
    "postal_code": _statement(["post"], "SELECT entity_id, postal AS postal_code FROM post"),
    "numeric_tokens": _statement(["side"], "SELECT entity_id, array_to_string(list_sort(num), ',') AS numbers FROM side"),
    "building_no": _statement(["side"], "SELECT entity_id, building AS building_no FROM side"),
    "building_no_enhanced": _statement(["post"], "SELECT entity_id, coalesce([x FOR x IN bare IF regexp_full_match(x, '\\d{1,6}')][1], '') AS building_no FROM post"),
    "locality_tokens": _statement(["side"], "SELECT entity_id, array_to_string(list_sort(loc), ',') AS localities FROM side"),
    "char_ngrams": _statement(["grams"], "SELECT entity_id, array_to_string(list_sort(n3), ',') AS grams_3, array_to_string(list_sort(n4), ',') AS grams_4 FROM grams"),
    "token_idf": _statement(["arr"], "SELECT token, round(ln(((SELECT count(*) FROM arr WHERE source = 1) + 1)::DOUBLE / (count(*) + 1)) + 1, 9) AS idf FROM (SELECT unnest(list_distinct(cw)) AS token FROM arr WHERE source = 1) GROUP BY token"),
    "keys_strategy": _statement(["keys"], "SELECT * FROM keys WHERE type IN ('NSORT', 'ADDR', 'UNIT', 'PLOT', 'POSTAL')"),
    "block_sizes": _statement(["sizes"], "SELECT * FROM sizes"),
    "pruned_blocks": _statement(["sizes"], "SELECT type, sum(size)::BIGINT AS n FROM sizes WHERE size <= 100 GROUP BY type"),
    "cand_count_score": _statement(["call"], "SELECT source1_id, candidate_id, candidate_source, blocking_score FROM call WHERE blocking_rank <= 300"),
    "cand_topk": _statement(["cand"], "SELECT source1_id, candidate_id, candidate_source, blocking_score, blocking_rank FROM cand"),
    "cand_rank_ratio": _statement(["call"], "SELECT source1_id, candidate_id, blocking_rank, blocking_score_ratio FROM call WHERE blocking_rank <= 10"),
    "cand_compactness": _statement(["call", "req"], "SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most, count(*) AS entities FROM (SELECT source1_id, count(candidate_id) AS n FROM req LEFT JOIN (SELECT * FROM call WHERE blocking_rank <= 300) USING (source1_id) GROUP BY source1_id)"),
    "search_space_reduction": _statement(["call", "ent"], "SELECT c AS candidate_pairs, q * t AS possible_pairs, round(1 - c::DOUBLE / (q * t), 8) AS reduction FROM (SELECT count(*) AS c FROM call WHERE blocking_rank <= 300), (SELECT count(*) FILTER (source = 1) AS q, count(*) FILTER (source <> 1) AS t FROM ent)"),
    "feat_labels": _statement(["cand", "truth"], "SELECT cand.source1_id, cand.candidate_id, CASE WHEN truth.source1_id IS NULL THEN 0 ELSE 1 END AS label FROM cand LEFT JOIN truth USING (source1_id, candidate_id)"),
    "match_threshold": _statement(["scored"], "SELECT source1_id, candidate_id, probability FROM scored WHERE probability >= 0.75::DOUBLE"),
    "match_country_rank_threshold": _statement(["scored"], f"{_IDS} scored WHERE probability >= {_RANK_T}"),
    "match_country_threshold": _statement(["scored"], f"{_IDS} scored WHERE probability >= CASE norm_country WHEN 'US' THEN 0.55::DOUBLE WHEN 'India' THEN 0.5::DOUBLE ELSE 0.55::DOUBLE END"),
    "veto_branch": _statement(["scored"], f"{_IDS} scored WHERE {_DIFF('norm_a', 'norm_b', vocab.BRANCH_DIRECTIONS)} OR {_DIFF('norm_a', 'norm_b', vocab.BRANCH_DIVISIONS)}"),
    "veto_building": _statement(["scored"], f"{_IDS} scored WHERE building_a <> '' AND building_b <> '' AND building_a <> building_b AND core_a <> core_b"),
    "cross_source_consistency": _statement(["scored"], """, p AS (SELECT *, row_number() OVER (PARTITION BY source1_id, candidate_source ORDER BY probability DESC, candidate_id) AS k FROM scored WHERE probability >= 0.5),
        clash AS (SELECT x.source1_id, CASE WHEN x.probability >= y.probability THEN y.candidate_id ELSE x.candidate_id END AS candidate_id FROM p x JOIN p y USING (source1_id) WHERE x.k = 1 AND y.k = 1 AND x.candidate_source = 'source2' AND y.candidate_source = 'source3' AND x.building_b <> '' AND y.building_b <> '' AND x.building_b <> y.building_b)
        SELECT source1_id, candidate_id FROM p ANTI JOIN clash USING (source1_id, candidate_id)"""),
    "match_lists_complete": _statement(["req", "passing"], _LISTS),
    "candidate_superset": _statement(["req", "passing", "wall"], f""", m AS ({_LISTS}), c AS (SELECT source1_id, list(candidate_id ORDER BY blocking_rank) AS ids FROM wall WHERE blocking_rank <= 5 GROUP BY source1_id)
        SELECT source1_id, matches, array_to_string(list_concat(coalesce(ids, []), CASE WHEN matches = '' THEN [] ELSE [x FOR x IN string_split(matches, ',') IF NOT list_contains(coalesce(ids, []), x)] END), ',') AS candidates FROM m LEFT JOIN c USING (source1_id)"""),
    "max_prob_gate": _statement(["scored"], f"{_IDS} (SELECT *, max(probability) OVER (PARTITION BY source1_id) AS best FROM scored WHERE probability >= 0.5::DOUBLE) WHERE best >= 0.7::DOUBLE"),
    "weak_name_guard": _statement(["scored"], f"{_IDS} scored WHERE probability >= 0.5::DOUBLE AND (nl >= 0.55::DOUBLE OR probability >= 0.7::DOUBLE)"),
    "entity_prf": _statement(["counts"], f"SELECT source1_id, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f FROM ({_prf('counts')})"),
    "macro_metrics": _statement(["counts"], f"SELECT macro_f05, macro_precision, macro_recall, singleton_accuracy, non_singleton_macro_f05, total_evaluated_s1, true_singletons, correct_singletons, false_merges_on_singletons FROM ({_summary('counts')})"),
    "micro_metrics": _statement(["counts"], f"SELECT micro_precision, micro_recall, micro_f05, total_tp_pairs, total_fp_pairs, total_fn_pairs FROM ({_summary('counts')})"),
    "metrics_by_country": _statement(["counts", "nrm"], f"SELECT norm_country, macro_f05, micro_f05, total_evaluated_s1 FROM ({_summary('(SELECT counts.*, norm_country FROM counts JOIN nrm ON nrm.entity_id = counts.source1_id)', 'norm_country')})"),
    "pair_confusion": _statement(["lab"], _POINT),
    "roc_auc": _statement(["lab"], "SELECT round((s - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS roc_auc FROM (SELECT sum(r) FILTER (label = 1) AS s, sum(label) AS p, count(*) AS n FROM (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r FROM lab))"),
    "threshold_sweep_pair": _statement(["lab"], _SWEEP),
    "threshold_sweep_macro": _statement(["scored", "truth", "req"], f"SELECT threshold, macro_f05, macro_precision, macro_recall, total_tp_pairs, total_fp_pairs, total_fn_pairs FROM ({_summary(_MACRO, 'threshold')})"),
    "best_threshold": _statement(["scored", "truth", "req"], f"SELECT threshold, macro_f05 FROM ({_summary(_MACRO, 'threshold')}) ORDER BY macro_f05 DESC, threshold LIMIT 1"),
    "blocking_recall": _statement(["cand", "truth", "req"], "SELECT n AS true_pairs, f AS found, round(f::DOUBLE / n, 6) AS recall, c AS candidate_pairs, round(c::DOUBLE / e, 6) AS per_entity FROM (SELECT count(*) AS n, count(cand.source1_id) AS f FROM truth LEFT JOIN cand USING (source1_id, candidate_id)), (SELECT count(*) AS c FROM cand), (SELECT count(*) AS e FROM req)"),
    "recall_decomposition": _statement(["scored", "truth"], "SELECT n AS true_pairs, i AS in_candidates, m AS matched, round(i::DOUBLE / n, 6) AS blocking_recall, round(m::DOUBLE / i, 6) AS classification_recall, round(m::DOUBLE / n, 6) AS system_recall FROM (SELECT count(*) AS n, count(probability) AS i, count(*) FILTER (probability >= 0.75) AS m FROM truth LEFT JOIN scored USING (source1_id, candidate_id))"),
    "missed_matches": _statement(["truth", "shared"], f"SELECT * FROM truth ANTI JOIN {_NARROW} USING (source1_id, candidate_id)"),
    "difficulty_breakdown": _statement(["truth", "nrm"], "SELECT CASE l WHEN 2 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n FROM (SELECT source1_id, bool_or(a.norm_name = b.norm_name AND a.norm_name <> '')::INT + bool_or(a.norm_addr = b.norm_addr AND a.norm_addr <> '')::INT AS l FROM truth JOIN nrm a ON a.entity_id = source1_id JOIN nrm b ON b.entity_id = candidate_id GROUP BY 1) GROUP BY ALL"),
    "error_buckets": _statement(["scored", "truth"], f""", t AS (SELECT truth.*, probability AS p FROM truth LEFT JOIN scored USING (source1_id, candidate_id)), w AS (SELECT * FROM scored ANTI JOIN truth USING (source1_id, candidate_id) WHERE probability >= 0.7)
        SELECT 'blocking_miss' AS bucket, count(*) FILTER (p IS NULL) AS n FROM t UNION ALL SELECT 'borderline', count(*) FILTER (p >= 0.5 AND p < 0.7) FROM t UNION ALL SELECT 'hard', count(*) FILTER (p < 0.5) FROM t
        UNION ALL SELECT 'singleton_fp', count(*) FROM w WHERE source1_id NOT IN (SELECT source1_id FROM truth) UNION ALL SELECT 'non_singleton_fp', count(*) FROM w WHERE source1_id IN (SELECT source1_id FROM truth)
        UNION ALL SELECT 'branch_collision', count(*) FROM w WHERE len([x FOR x IN list_concat(string_split(core_a, ' '), string_split(core_b, ' ')) IF list_contains({_list(vocab.COLLISION_WORDS)}, x) AND list_contains(string_split(core_a, ' '), x) <> list_contains(string_split(core_b, ' '), x)]) > 0"""),
    "country_threshold_grid": _statement(["scored", "truth", "req"], "SELECT t_us, t_other, macro_f05, macro_precision, macro_recall FROM (" + _summary(_counts_over(f"{_values('t_us', [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8])} CROSS JOIN {_values('t_other', [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8])}", "t_us, t_other", "probability >= CASE WHEN norm_country = 'US' THEN t_us ELSE t_other END"), "t_us, t_other") + ")"),
    "gate_grid": _statement(["scored", "truth", "req"], "SELECT t_base, gap, macro_f05, singleton_accuracy, non_singleton_macro_f05 FROM (" + _summary(_counts_over(f"{_values('t_base', [0.5, 0.55, 0.6, 0.65, 0.7, 0.75])} CROSS JOIN {_values('gap', [0.0, 0.05, 0.1, 0.15, 0.2])}", "t_base, gap", "probability >= t_base", "WHERE best >= t_base + gap AND (nl >= 0.55::DOUBLE OR probability >= t_base + gap)"), "t_base, gap") + ")"),
    "validator_violations": r"""WITH l AS (SELECT 'S1-' || o_custkey AS s1, o_orderkey % 97 <> 0 AS tab, ['S2-' || o_orderkey % 50, 'S' || o_orderkey % 4 || '-' || o_orderkey % 30] AS ids FROM orders), g AS (SELECT * FROM l WHERE tab), e AS (SELECT s1, unnest(ids) AS id FROM g), r AS (SELECT 'S1-' || c_custkey AS s1 FROM customer), v AS (
        SELECT DISTINCT 'malformed_row' AS rule, s1 AS id FROM l WHERE NOT tab UNION ALL SELECT 'duplicate_row', s1 FROM g GROUP BY s1 HAVING count(*) > 1
        UNION ALL SELECT DISTINCT 'duplicate_id', s1 FROM g WHERE ids[1] = ids[2] UNION ALL SELECT DISTINCT 'self_match', id FROM e WHERE starts_with(id, 'S1-')
        UNION ALL SELECT DISTINCT 'bad_prefix', id FROM e WHERE NOT regexp_matches(id, '^S[123]-') UNION ALL SELECT DISTINCT 'missing_s1', s1 FROM r WHERE s1 NOT IN (SELECT s1 FROM g) UNION ALL SELECT DISTINCT 'extra_s1', s1 FROM g WHERE s1 NOT IN (SELECT s1 FROM r))
        SELECT rule, 'error' AS severity, count(*) AS n FROM v GROUP BY rule""",
}

for _kind in ("NP4", "NP6", "NCOMP", "TOK", "TOK3", "NSORT", "ADDR", "UNIT", "PLOT", "POSTAL", "ADDR_LOC"):
    ORACLE_SQL[f"keys_{_kind.lower()}"] = _statement(["keys"], f"SELECT * FROM keys WHERE type = '{_kind}'")

_SIGC = f"(SELECT *, [x FOR x IN {_words('core_name')} IF length(x) >= 3 AND NOT list_contains({_list(vocab.GENERIC_TERMS_ENHANCED)}, x)] AS s, replace(core_name, ' ', '') AS compact FROM post)"
ORACLE_SQL |= {
    "keys_npair": _statement(["post"], f"SELECT DISTINCT norm_country AS country, 'NPAIR' AS type, least(s[i], s[j]) || '_' || greatest(s[i], s[j]) AS value, entity_id, source FROM {_SIGC}, (SELECT unnest([1, 1, 1, 2, 2, 3]) AS i, unnest([2, 3, 4, 3, 4, 4]) AS j) WHERE j <= len(s)"),
    "keys_zip_tok": _statement(["post"], f"SELECT norm_country AS country, 'ZIP_TOK' AS type, postal || '_' || s[1] AS value, entity_id, source FROM {_SIGC} WHERE postal <> '' AND len(s) >= 1"),
    "keys_np4_zip": _statement(["post"], f"SELECT norm_country AS country, 'NP4_ZIP' AS type, substr(compact, 1, 4) || '_' || postal AS value, entity_id, source FROM {_SIGC} WHERE postal <> '' AND length(compact) >= 4"),
}

_FEATURES = {
    "name_exact": _flag("a.business_name = b.business_name AND a.business_name <> ''"),
    "name_normalized_exact": _flag("a.norm_name = b.norm_name AND a.norm_name <> ''"),
    "address_exact": _flag("a.business_address = b.business_address AND a.business_address <> ''"),
    "address_normalized_exact": _flag("a.norm_addr = b.norm_addr AND a.norm_addr <> ''"),
    "name_core_exact": _flag("a.core_name = b.core_name AND a.core_name <> ''"),
    "name_levenshtein": _lev("a.norm_name", "b.norm_name"),
    "address_levenshtein": _lev("a.norm_addr", "b.norm_addr"),
    "name_jaccard": _jac("a.cs", "b.cs"),
    "address_jaccard": _jac("a.as_", "b.as_"),
    "name_token_overlap": _over("a.cs", "b.cs"),
    "address_token_overlap": _over("a.as_", "b.as_"),
    "common_name_tokens": "len(list_intersect(a.cs, b.cs))::DOUBLE",
    "common_address_tokens": "len(list_intersect(a.as_, b.as_))::DOUBLE",
    "name_char_3gram_jaccard": _jac("a.n3", "b.n3"),
    "address_char_3gram_jaccard": _jac("a.a3", "b.a3"),
    "name_char_4gram_jaccard": _jac("a.n4", "b.n4"),
    "name_length_difference": "abs(length(a.norm_name) - length(b.norm_name))::DOUBLE",
    "address_length_difference": "abs(length(a.norm_addr) - length(b.norm_addr))::DOUBLE",
    "name_token_count_difference": "abs(len(a.nw) - len(b.nw))::DOUBLE",
    "address_token_count_difference": "abs(len(a.aw) - len(b.aw))::DOUBLE",
    "name_contains_other": _contains("a.norm_name", "b.norm_name"),
    "address_contains_other": _contains("a.norm_addr", "b.norm_addr"),
    "building_number_match": "CASE WHEN a.building = '' OR b.building = '' THEN 0.5 WHEN a.building = b.building THEN 1.0 ELSE 0.0 END",
    "locality_match": "CASE WHEN len(a.loc) = 0 OR len(b.loc) = 0 THEN 0.5 WHEN len(list_intersect(a.loc, b.loc)) >= 2 THEN 1.0 WHEN len(list_intersect(a.loc, b.loc)) = 1 THEN 0.75 ELSE 0.0 END",
    "country_match": _flag("a.norm_country = b.norm_country AND a.norm_country <> ''"),
    "candidate_source_is_s2": _flag("candidate_source = 'source2'"),
    "has_both_addresses": _flag("a.norm_addr <> '' AND b.norm_addr <> ''"),
    "either_address_empty": _flag("a.norm_addr = '' OR b.norm_addr = ''"),
    "numeric_token_overlap": "CASE WHEN len(a.num) > 0 AND len(b.num) > 0 THEN len(list_intersect(a.num, b.num)) ELSE 0 END::DOUBLE",
    "numeric_token_conflict": _flag("len(a.num) > 0 AND len(b.num) > 0 AND len(list_intersect(a.num, b.num)) = 0"),
    "name_first_token_match": _flag("a.nw[1] = b.nw[1]"),
    "blocking_score": "blocking_score",
    "blocking_rank": "blocking_rank",
    "blocking_score_ratio": "blocking_score_ratio",
}

# variant C: its own keys, counted scores and features
CTES |= {
    "sigc": (["post"], f"SELECT *, [x FOR x IN {_words('core_name')} IF length(x) >= 3 AND NOT list_contains({_list(vocab.GENERIC_TERMS_ENHANCED)}, x)] AS s, replace(core_name, ' ', '') AS compact, {_words('norm_addr')} AS aw, {_words('core_name')} AS cw FROM post"),
    "codesc": (
        ["sigc"],
        """SELECT entity_id, w, p, regexp_matches(p, '\\d') AND regexp_matches(p, '[a-z]') AND length(p) BETWEEN 3 AND 8 AS is_unit, contains(w, '/') AND regexp_matches(w, '\\d') AND length(w) <= 8 AS is_plot
           FROM (SELECT entity_id, w, regexp_replace(w, '[-/]', '', 'g') AS p FROM (SELECT entity_id, unnest(aw) AS w FROM sigc)) WHERE NOT regexp_full_match(p, '\\d+(st|nd|rd|th)')""",
    ),
    "k0c": (
        ["sigc", "codesc"],
        f"""SELECT entity_id, 'NP4' AS type, substr(compact, 1, 4) AS value FROM sigc WHERE length(compact) >= 4
            UNION SELECT entity_id, 'NP6', substr(compact, 1, 6) FROM sigc WHERE length(compact) >= 6
            UNION SELECT entity_id, 'NCOMP', compact FROM sigc WHERE length(compact) >= 5
            UNION SELECT entity_id, 'TOK', x FROM (SELECT entity_id, unnest(s) AS x FROM sigc) WHERE length(x) >= 4
            UNION SELECT entity_id, 'TOK3', x FROM (SELECT entity_id, unnest(s) AS x FROM sigc) WHERE regexp_full_match(x, '[a-z]{{3}}')
            UNION SELECT entity_id, 'NSORT', array_to_string(list_sort(s[1:4]), '_') FROM sigc WHERE len(s) >= 2
            UNION SELECT entity_id, 'NPAIR', least(s[i], s[j]) || '_' || greatest(s[i], s[j]) FROM sigc, (SELECT unnest([1, 1, 1, 2, 2, 3]) AS i, unnest([2, 3, 4, 3, 4, 4]) AS j) WHERE j <= len(s)
            UNION SELECT entity_id, 'ZIP_TOK', postal || '_' || s[1] FROM sigc WHERE postal <> '' AND len(s) >= 1
            UNION SELECT entity_id, 'NP4_ZIP', substr(compact, 1, 4) || '_' || postal FROM sigc WHERE postal <> '' AND length(compact) >= 4
            UNION SELECT entity_id, 'UNIT', p FROM codesc WHERE is_unit
            UNION SELECT entity_id, 'PLOT', w FROM codesc WHERE NOT is_unit AND is_plot
            UNION SELECT entity_id, 'ADDR_LOC', l[1] || '_' || l[2] FROM (SELECT entity_id, [x FOR x IN aw IF length(x) >= 4 AND regexp_full_match(x, '[a-z]+') AND NOT list_contains({_list(vocab.LOCALITY_KEY_STOP_ENHANCED)}, x)] AS l FROM sigc) WHERE len(l) >= 2""",
    ),
    "keysc": (["k0c", "post"], "SELECT norm_country AS country, type, value, entity_id, source FROM k0c JOIN post USING (entity_id)"),
    "candc": (
        ["keysc"],
        """SELECT *, score::DOUBLE AS blocking_score, k::DOUBLE AS blocking_rank, score::DOUBLE / most AS blocking_score_ratio FROM (SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY score DESC, candidate_id) AS k, max(score) OVER (PARTITION BY source1_id) AS most FROM (SELECT q.entity_id AS source1_id, t.entity_id AS candidate_id, 'source' || t.source AS candidate_source, count(*) AS score FROM keysc q JOIN keysc t USING (country, type, value)
           JOIN (SELECT country, type, value FROM keysc WHERE source <> 1 GROUP BY ALL HAVING count(*) <= 1000) USING (country, type, value) WHERE q.source = 1 AND t.source <> 1 GROUP BY ALL)) WHERE k <= 20""",
    ),
    "pairc": (["candc", "sigc"], "SELECT c.source1_id, c.candidate_id, a, b, list_intersect(list_distinct(a.cw), list_distinct(b.cw)) AS i, list_distinct(list_concat(a.cw, b.cw)) AS u FROM candc c JOIN sigc a ON a.entity_id = c.source1_id JOIN sigc b ON b.entity_id = c.candidate_id"),
    "idfc": (["sigc"], "SELECT token, ln(((SELECT count(*) FROM sigc WHERE source = 1) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(list_distinct(cw)) AS token FROM sigc WHERE source = 1) GROUP BY token"),
    "wordc": (["sigc", "idfc"], "SELECT entity_id, token, coalesce(idf, 1.0) AS w FROM (SELECT entity_id, unnest(list_distinct(cw)) AS token FROM sigc) LEFT JOIN idfc USING (token)"),
    "totalc": (["wordc"], "SELECT entity_id, sum(w) AS w FROM wordc GROUP BY entity_id"),
    "sharedc": (["candc", "wordc"], "SELECT source1_id, candidate_id, sum(x.w) AS w FROM candc JOIN wordc x ON x.entity_id = source1_id JOIN wordc y ON y.entity_id = candidate_id AND y.token = x.token GROUP BY ALL"),
    "weighedc": (
        ["candc", "totalc", "sharedc"],
        "SELECT c.source1_id, c.candidate_id, CASE WHEN x.w IS NULL OR y.w IS NULL THEN 0.0 ELSE coalesce(s.w, 0.0) / (x.w + y.w - coalesce(s.w, 0.0)) END AS name_idf_weighted_jaccard FROM candc c LEFT JOIN totalc x ON x.entity_id = c.source1_id LEFT JOIN totalc y ON y.entity_id = c.candidate_id LEFT JOIN sharedc s ON s.source1_id = c.source1_id AND s.candidate_id = c.candidate_id",
    ),
    "sidec": (["sigc"], _side(f"(SELECT *, {_words('norm_name')} AS nw FROM sigc)", vocab.LOCALITY_STOP_ENHANCED, "coalesce([x FOR x IN bare IF regexp_full_match(x, '\\d{1,6}')][1], '')", ", postal, compact")),
    "gramsc": (["sidec"], _grams("sidec")),
    "fullc": (["candc", "gramsc"], "SELECT c.*, a, b, list_intersect(a.cs, b.cs) AS i FROM candc c JOIN gramsc a ON a.entity_id = c.source1_id JOIN gramsc b ON b.entity_id = c.candidate_id"),
    "textsc": (["fullc"], _words_cte("fullc")),
    "ratioc": (["textsc"], _ratio_cte("textsc")),
}
_PREFIX = "CASE WHEN length(a.compact) >= 4 AND length(b.compact) >= 4 AND substr(a.compact, 1, 4) = substr(b.compact, 1, 4) THEN 1.0 WHEN length(a.compact) >= 3 AND length(b.compact) >= 3 AND substr(a.compact, 1, 3) = substr(b.compact, 1, 3) THEN 0.5 ELSE 0.0 END"
ORACLE_SQL |= {
    "feat_prefix": _statement(["pairc"], f"SELECT source1_id, candidate_id, {_PREFIX}::DOUBLE AS name_prefix_similarity, len([x FOR x IN i IF length(x) >= 4 AND NOT list_contains({_list(vocab.GENERIC_TERMS_ENHANCED)}, x)])::DOUBLE AS name_rare_token_overlap, CASE WHEN a.postal = '' OR b.postal = '' THEN 0.5 WHEN a.postal = b.postal THEN 1.0 ELSE 0.0 END::DOUBLE AS postal_code_match FROM pairc"),
    "feat_idf_jaccard": _statement(["pairc", "weighedc"], f"SELECT source1_id, candidate_id, {_PREFIX}::DOUBLE AS name_prefix_similarity, round(name_idf_weighted_jaccard, 9) AS name_idf_weighted_jaccard FROM pairc JOIN weighedc USING (source1_id, candidate_id)"),
    "error_patterns": _statement(
        ["lab", "side"],
        """SELECT kind, pattern, count(*) AS n FROM (SELECT CASE WHEN label = 0 THEN 'fp' ELSE 'fn' END AS kind,
             CASE WHEN label = 0 THEN CASE WHEN lower(trim(a.business_name)) = lower(trim(b.business_name)) THEN 'identical name, different location' WHEN a.norm_country = b.norm_country AND a.building <> b.building THEN 'similar name, different building' ELSE 'common name collision' END
             ELSE CASE WHEN b.business_address = '' THEN 'candidate address missing' WHEN a.building <> '' AND b.building <> '' AND a.building <> b.building THEN 'building number discrepancy' ELSE 'spelling or alias variation' END END AS pattern
           FROM lab JOIN side a ON a.entity_id = source1_id JOIN side b ON b.entity_id = candidate_id WHERE (label = 0 AND probability >= 0.75) OR (label = 1 AND probability < 0.75)) GROUP BY ALL""",
    ),
}


def _strategy_sql() -> str:
    from corvane.operators.diagnose import STRATEGY_SETS

    kept = " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, source1_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY s DESC, candidate_id) AS k FROM (SELECT source1_id, candidate_id, count(*) AS s FROM shared WHERE size <= {cap} AND list_contains({_list(types)}, type) GROUP BY ALL)) WHERE k <= {k}"
        for name, types, cap, k in STRATEGY_SETS
    )
    return _statement(["shared", "truth"], f", kept AS MATERIALIZED ({kept}) SELECT strategy, count(kept.source1_id) AS candidate_pairs, count(t.source1_id) AS found, count(*) FILTER (t.source1_id IS NOT NULL AND f.source1_id IS NULL) AS gained FROM (SELECT unnest({_list([n for n, *_ in STRATEGY_SETS])}) AS strategy) LEFT JOIN kept USING (strategy) LEFT JOIN truth t USING (source1_id, candidate_id) LEFT JOIN (SELECT source1_id, candidate_id FROM kept WHERE strategy = '{STRATEGY_SETS[0][0]}') f USING (source1_id, candidate_id) GROUP BY strategy")


ORACLE_SQL["strategy_benchmark"] = _strategy_sql()


_SOURCED = """(SELECT source1_id, candidate_source, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM req CROSS JOIN (SELECT unnest(['source2', 'source3']) AS candidate_source)
      LEFT JOIN (SELECT source1_id, 'source' || substr(candidate_id, 2, 1) AS candidate_source, count(*) AS n_true FROM truth GROUP BY ALL) USING (source1_id, candidate_source)
      LEFT JOIN (SELECT p.source1_id, p.candidate_source, count(*) AS n_pred, count(t.source1_id) AS tp FROM passing p LEFT JOIN truth t USING (source1_id, candidate_id) GROUP BY ALL) USING (source1_id, candidate_source))"""
_PROSE = {"ent": DOCUMENT_SQL}
_FOLDED = lambda c: f"regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g') AS {c.split('.')[-1]}"
_NA = _list(vocab.NA_TOKENS)
_MATCHED = "SELECT source1_id, coalesce(string_agg(candidate_id, ',' ORDER BY probability DESC, candidate_id), '') AS l FROM req LEFT JOIN passing USING (source1_id) GROUP BY source1_id"
_GIVEN = "SELECT source1_id, coalesce(string_agg(candidate_id, ',' ORDER BY blocking_rank), '') AS l FROM req LEFT JOIN cand USING (source1_id) GROUP BY source1_id"
_CAND20 = "SELECT q.entity_id AS source1_id, t.entity_id AS candidate_id, count(*)::DOUBLE AS blocking_score FROM keys q JOIN keys t USING (country, type, value) JOIN sizes USING (country, type, value) WHERE q.source = 1 AND t.source <> 1 AND size <= 20 AND type IN ('NP4', 'NP6', 'NCOMP', 'TOK') GROUP BY ALL"
ORACLE_SQL |= {f"keys_enhanced_{k.lower()}": _statement(["keysc"], f"SELECT * FROM keysc WHERE type = '{k}'") for k in ("NP4", "NP6", "NCOMP", "TOK", "TOK3", "NSORT", "UNIT", "PLOT", "ADDR_LOC")}
ORACLE_SQL |= {
    "locality_tokens_enhanced": _statement(["sidec"], "SELECT entity_id, array_to_string(list_sort(loc), ',') AS localities FROM sidec"),
    "metrics_by_source": _statement(["req", "passing", "truth"], f"SELECT candidate_source, macro_f05, macro_precision, macro_recall, singleton_accuracy, non_singleton_macro_f05, total_evaluated_s1, true_singletons, correct_singletons, false_merges_on_singletons, micro_precision, micro_recall, micro_f05, total_tp_pairs, total_fp_pairs, total_fn_pairs FROM ({_summary(_SOURCED, 'candidate_source')})"),
    "group_split": _statement(["req"], f"SELECT source1_id, ('0x' || substr(md5(source1_id || ':42'), 1, 10))::BIGINT < {int(0.2 * (1 << 40))} AS held_out FROM req"),
    "na_policies_of_a_run": f"SELECT 'S' || n || '-' || p_partkey AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN n = 1 THEN '' ELSE ({_NA})[p_partkey % {len(vocab.NA_TOKENS)} + 1] END AS business_name, n AS source FROM part, (SELECT unnest([1, 2, 3])::INT AS n)",
    "truth_file": _statement(["truth"], "SELECT * FROM truth"),
    "id_scan": _statement(["ent"], "SELECT entity_id FROM ent"),
    "semi_scan_country": _statement(["ent", "truth"], "SELECT entity_id, business_name FROM ent WHERE country = 'USA' AND entity_id IN (SELECT candidate_id FROM truth)"),
    "submission_lines": _statement(
        ["req", "passing", "cand"],
        f"""SELECT 'matching_results' AS file, source1_id || chr(9) || l AS line FROM ({_MATCHED}) UNION ALL SELECT 'candidate_pairs', source1_id || chr(9) || l FROM ({_GIVEN})
            UNION ALL SELECT 'matching_results', 'source1_entity_id' || chr(9) || 'matched_entity_ids' UNION ALL SELECT 'candidate_pairs', 'source1_entity_id' || chr(9) || 'candidate_entity_ids'""",
    ),
    "validator_files": """WITH c AS (SELECT count(*) AS all_, count(*) FILTER (c_custkey % 5 = 0) AS fives, count(*) FILTER (c_custkey % 5 = 0 AND c_custkey = 7) AS sevens FROM customer)
        SELECT 0 AS "case", 'match_not_candidate' AS rule, 'warning' AS severity, fives - sevens AS n FROM c
        UNION ALL SELECT 1, 'no_candidate_file', 'warning', 1 UNION ALL SELECT 1, 'ids_not_checked', 'warning', 1
        UNION ALL SELECT 2, 'comma_separated', 'error', 1 UNION ALL SELECT 2, 'wrong_header', 'error', 1
        UNION ALL SELECT 3, 'empty_file', 'error', 1 UNION ALL SELECT 3, 'file_not_found', 'error', 1""",
    "prose_norm_name": _statement(["nrm"], f"SELECT entity_id, {_FOLDED('nrm.norm_name')}, {_FOLDED('nrm.core_name')} FROM nrm", _PROSE),
    "prose_norm_address": _statement(["na"], f"SELECT entity_id, {_FOLDED('norm_addr')} FROM na", _PROSE),
    "prose_candidates": _statement(["keys", "sizes"], f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source1_id ORDER BY blocking_score DESC, candidate_id)::DOUBLE AS blocking_rank FROM ({_CAND20})) WHERE blocking_rank <= 10", _PROSE),
    "is_indic": _statement(["ent"], "SELECT entity_id, number % 3 = 0 AS is_indic FROM ent"),
}


ORACLE_SQL["miss_categories"] = _statement(
    ["truth", "shared"],
    f"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN k = 0 THEN 'key pruned' WHEN k > 0 THEN 'truncated by top-k' ELSE 'no key' END AS category FROM (SELECT * FROM truth ANTI JOIN {_NARROW} USING (source1_id, candidate_id))
        LEFT JOIN (SELECT source1_id, candidate_id, count(*) FILTER (size <= 3) AS k FROM shared GROUP BY ALL) USING (source1_id, candidate_id)) GROUP BY category""",
)
_LOST = lambda i: f"replace(({_list([x[i] for x in LOST])})[p_partkey % {len(LOST)} + 1], ':', translate(p_partkey::VARCHAR, '0123456789', 'aeioubdmnt'))"
ORACLE_SQL["miss_reasons_by_case"] = f"SELECT 'S1-' || p_partkey AS source1_id, 'S2-' || p_partkey AS candidate_id, {_LOST(0)} AS category, {_LOST(1)} AS source1_name, {_LOST(3)} AS candidate_name, {_LOST(2)} AS source1_address, {_LOST(4)} AS candidate_address FROM part"


_RATIOS = {"name_token_sort_ratio", "name_token_set_ratio", "address_token_set_ratio"}
_ENHANCED = _FEATURES | {
    "name_first_token_match": _flag("a.cw[1] = b.cw[1]"),
    "name_prefix_similarity": f"{_PREFIX}::DOUBLE",
    "name_rare_token_overlap": f"len([x FOR x IN i IF length(x) >= 4 AND NOT list_contains({_list(vocab.GENERIC_TERMS_ENHANCED)}, x)])::DOUBLE",
    "postal_code_match": "CASE WHEN a.postal = '' OR b.postal = '' THEN 0.5 WHEN a.postal = b.postal THEN 1.0 ELSE 0.0 END::DOUBLE",
}


def _feature_sql() -> dict[str, str]:
    from corvane.plans.queries import FEATURE_QUERIES

    out = {}
    for name, (wanted, variant) in FEATURE_QUERIES.items():
        if name in ORACLE_SQL:
            continue
        source, own = ("pair", _FEATURES) if variant == "base" else ("fullc", _ENHANCED)
        needs, joins = [source], ""
        if _RATIOS & set(wanted):
            needs.append("ratio" if variant == "base" else "ratioc")
            joins += f" JOIN {needs[-1]} USING (source1_id, candidate_id)"
        if "name_idf_weighted_jaccard" in wanted:
            needs.append("weighedc")
            joins += " JOIN weighedc USING (source1_id, candidate_id)"
        columns = ", ".join(f"round(({own.get(n, n)})::DOUBLE, 9) AS {n}" for n in wanted)
        out[name] = _statement(needs, f"SELECT source1_id, candidate_id, {columns} FROM {source}{joins}")
    return out


ORACLE_SQL |= _feature_sql()
assert not re.search(r"\{\w", "".join(ORACLE_SQL))
