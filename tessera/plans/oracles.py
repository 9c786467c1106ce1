"""DuckDB SQL for the queries, built on the same rules."""

from __future__ import annotations

from ..functions.predicates import key_of
from ..functions.text import GLYPHS, MORE_GLYPHS, NAME_LABELS, SPLIT_MARKS, _quoted
from ..rules import BEFORE_THING, INVALID_CANDIDATES, LABEL_ORDER, LABELS, LINK_ENDS, NAME_ENDS, NAME_STARTS, SENTINELS, UNKNOWN
from .labels import over_labels

R = LABELS


def key(x: str) -> str:
    return f"translate(lower({x}), ' ' || chr(10) || chr(13) || chr(9) || '-_:：.,，;；/·ㆍ[](){{}}', '')"


def clean(x: str) -> str:
    for old, new in ((r"\s+", " "), (r"\s*,\s*", ", "), (r"\s*;\s*", "; "), (r"\s*:\s*", ": "), (r"\s+([,.;:)\]\}])", r"\1"), (r"([(\[\{])\s+", r"\1"), ("([,;])([가-힣A-Za-z0-9])", r"\1 \2")):
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    return f"trim({x})"


def clean_recognised(x: str) -> str:
    for old, new in GLYPHS + MORE_GLYPHS:
        x = "replace({}, '{}', '{}')".format(x, old, new.replace("'", "''"))
    return clean(x)


def splittable(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for old, new in (*((a, b) for a, b in SPLIT_MARKS if a != "\t"), ("㎖", "ml"), ("ｍｌ", "ml"), ("ＭＬ", "ml")):
        x = f"replace({x}, '{old}', '{new}')"
    for old, new in ((r"\t", " "), (r"\s*,\s*", ", "), (r"\s*;\s*", "; "), (r"\s*:\s*", ": "), (" +", " "), (r" *\n *", r"\n")):
        x = f"regexp_replace({x}, '{old}', {'chr(10)' if new == chr(92) + 'n' else chr(39) + new + chr(39)}, 'g')"
    return f"trim({x}, ' ' || chr(10))"


def plain_name(x: str) -> str:
    for old, new in zip("，、；ㆍ：", ",,;·:"):
        x = f"replace({x}, '{old}', '{new}')"
    x = f"trim({x}, ' ,.;:/·-[]{{}}()')"
    for label in NAME_LABELS:
        x = f"list_transform([{x}], lambda v: CASE WHEN lower(v).starts_with('{label}') THEN trim(v[{len(label) + 1}:], ' :-') ELSE v END)[1]"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def has(k: str, words: tuple[str, ...]) -> str:
    keys = list(dict.fromkeys(x for x in map(key_of, words) if x))
    return f"regexp_matches({k}, '{'|'.join(_quoted(x) for x in keys)}')"


def hits(k: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({k}, '{key_of(w)}')::INT" for w in words) + ")"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def flat(pattern: str) -> str:
    """A Java pattern in RE2's words: look-around goes where the data cannot tell it apart."""
    return pattern.replace(BEFORE_THING, "").replace("(?U:\\s)", "\\s").replace("(?<!\\d)", "(?:^|\\D)").replace("(?!\\d)", "(?:\\D|$)").replace("(?![가-힣A-Za-z0-9_])", "(?:[^가-힣A-Za-z0-9_]|$)").replace("'", "''")


URL, AMOUNT = flat(R.url), flat(R.amount)
SEPARATORS = "(len({0}) - len(translate({0}, ',，、;；·ㆍ', '')))"
LINES = f"(SELECT doc_id, lang, i - 1 AS line_index, {clean('raw')} AS text FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE {clean('raw')} <> '')"
HEADER = f"(text <> '' AND (regexp_matches(text, '{URL}') OR len(text) <= 25 OR (regexp_matches(text, '^.{{1,20}}[：:]\\s*.+') AND len(trim(regexp_extract(text, '^(.{{1,20}})[：:]\\s*(.+)', 1))) <= 15)))"
LABEL = f"CASE WHEN {HEADER} THEN CASE " + " ".join(f"WHEN {has('k', R.keywords(s))} THEN '{s}'" for s in LABEL_ORDER) + " END END"
NOISE = f"(k = '' OR k IN ({', '.join(repr(key_of(w)) for w in R.noise)}) OR regexp_matches(text, '소비자가|신문') OR regexp_matches(text, '^[a-zA-Z]{{1,3}}$|^[가-힣]$|^[-_=~.ㆍ·,，;；:：|/\\\\]+$'))"
NOT_AMOUNT = has("k", R.not_capacity)


def meta(text: str, k: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{flat(p)}')" for p in (R.company, R.address, R.phone, R.lot, R.date)) + f" OR {has(k, R.makers)})"


def is_amount(text: str, k: str) -> str:
    return f"(NOT {has(k, R.not_capacity)} AND regexp_matches({text}, '{AMOUNT}'))"


#: Tokens of a column named text: split, cleaned, of an allowed length, no numbers, short Latin, amounts or links.
ENDS = r"^[ ,.;:：/·ㆍ\-()\[\]{}]+|[ ,.;:：/·ㆍ\-()\[\]{}]+$"
TOKENS = (
    f"list_filter(list_transform(regexp_split_to_array(text, '[,，、;；·ㆍ/\\n]+'), lambda x: regexp_replace({clean('x')}, '{ENDS}', '', 'g')), lambda x: len(x) BETWEEN 2 AND 50 "
    f"AND NOT regexp_matches(x, '^\\d+$|^[a-zA-Z]{{1,3}}$') AND NOT {is_amount('x', key('x'))} AND NOT regexp_matches(x, '{URL}'))"
)
KNOWN = "({0} IS NOT NULL AND trim({0}) <> '' AND trim({0}) NOT IN (" + ", ".join(f"'{s}'" for s in SENTINELS) + "))"


def penalty(text: str, k: str) -> str:
    return f"({hits(k, R.not_ingredients)} + 2 * regexp_matches({text}, '{R.polite}')::INT + (len({text}) >= 45 AND {SEPARATORS.format(text)} = 0)::INT)"


def query(x: str) -> str:
    """clean_query(search_hint(x)) for names without Hangul."""
    x = f"trim(regexp_replace(regexp_replace({x}, '([0-9])\\s*(ppm|PPM)', '\\1ppm', 'g'), '\\s+', ' ', 'g'))"
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '[^가-힣a-zA-Z0-9,\\-/\\s]', '', 'g'), ' +', ' ', 'g'), ',+', ',', 'g')"
    return f"trim(regexp_replace({x}, '^[ ,;:/\\-]+|[ ,;:/\\-]+$', '', 'g'))"


def title(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for old, new in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{old}', '{new}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


HTML_TITLE = title("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
DESCRIPTION = "coalesce(" + ", ".join(
    f"nullif({title(f'regexp_extract(html, {chr(39)}{p}{chr(39)}, 1)')}, '')"
    for n in ("description", "og:description")
    for p in (f'(?is)<meta[^>]+(?:name|property)=["\'\']{n}["\'\'][^>]+content=["\'\'](.*?)["\'\']', f'(?is)<meta[^>]+content=["\'\'](.*?)["\'\'][^>]+(?:name|property)=["\'\']{n}["\'\']')
) + ", '')"
WITH_SCHEME = "CASE WHEN regexp_matches(b, '(?i)^https?://') THEN b WHEN regexp_matches(b, '(?i)^(?:www\\.|[a-z0-9][a-z0-9-]*(?:\\.[a-z0-9-]+)+(?:[/?#:].*)?$)') THEN 'https://' || b ELSE b END"


def usage_of(x: str, k: str, structure: str) -> str:
    """The usage rule for a text; the caution endings and the advertisement are those of sql_advert and flat()."""
    hangul = f"len(regexp_replace({x}, '[^가-힣]', '', 'g'))"
    return f"(len(trim({x})) >= 5 AND {hangul} >= 3 AND NOT {sql_advert(x)} AND NOT {structure} AND NOT regexp_matches({x}, '{flat(R.caution_ending)}') AND (regexp_matches({x}, '{flat(R.usage_ending)}') OR {has(k, R.usage_signals)}))"


def sql_advert(x: str) -> str:
    return (
        f"(len(trim({x})) >= 8 AND regexp_matches(trim({x}), '{flat(R.advert)}') AND NOT regexp_matches(trim({x}), '{flat(R.usage_ending)}') AND NOT regexp_matches(trim({x}), '{flat(R.caution_ending)}') "
        f"AND len({x}) - len(replace({x}, ',', '')) < 2 AND {count(f'trim({x})', flat(R.suffix))} < 2)"
    )


def caution_of(x: str, k: str) -> str:
    return f"((regexp_matches({x}, '{flat(R.caution_ending)}') AND NOT {sql_advert(x)} AND NOT {meta(x, k)}) OR {has(k, R.caution_signals)})"


def like_name(x: str) -> str:
    """A token of a list: not usage, caution or a maker's note, and with a letter. Facts of tokens are rare, so the cheap test goes first."""
    k = key(x)
    plain = f"({count(x, flat(R.suffix))} >= 2 AND NOT {sql_advert(x)} AND NOT {meta(x, k)})"
    return f"(regexp_matches({x}, '[가-힣A-Za-z]') AND NOT {meta(x, k)} AND NOT {caution_of(x, k)} AND NOT {usage_of(x, k, plain)})"


STRONG = (
    f"(len(trim(text)) >= 10 AND NOT (phone OR regexp_matches(text, '{flat(R.company)}') OR regexp_matches(text, '{flat(R.lot)}')) AND ({count('text', flat(R.caution_ending))} >= 2 OR ({count('text', flat(R.caution_ending))} >= 1 "
    f"AND (regexp_matches(text, '(?:^|[^\\pL\\pN_])\\d+\\s*[.\\)]\\s*[가-힣]') OR regexp_matches(text, '[가-힣]\\s*\\)\\s*[가-힣]') OR {has('k', R.strong_cautions)}))))"
)
IMPLICIT = (
    f"CASE WHEN text = '' THEN NULL WHEN url THEN 'qr_url' WHEN {STRONG} THEN 'cautions' WHEN meta THEN 'others' WHEN advert THEN CASE WHEN {has('k', R.effects_content)} THEN 'effects' ELSE 'others' END "
    "WHEN amount THEN 'capacity' WHEN listed THEN 'ingredients' WHEN caution THEN 'cautions' WHEN usage THEN 'usage' END"
)


def without_own_label(section: str) -> str:
    x = "text"
    for k in R.keywords(section):
        x = f"regexp_replace({x}, '(?i)^\\s*{_quoted(k)}\\s*[:：]?\\s*', '')"
    return f"trim({x})"


VALUE = "CASE label " + " ".join(f"WHEN '{s}' THEN {without_own_label(s)}" for s in ("product_name", "capacity", "ingredients", "usage", "cautions", "effects", "qr_url")) + " END"
_NAME_WORDS = R.ingredients + R.usage + R.cautions + R.capacity + R.makers + R.links + R.storage
_SEPARATORS = SEPARATORS.format("text")
#: Every line of the documents with its facts, each level made of those before it; line_index is the place among all lines, pos that among the lines that are not blank.
FACTS = f"""l0 AS (SELECT doc_id, line_index, text, {key('text')} AS k, {_SEPARATORS} AS n_separators FROM {LINES}),
l1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS pos, regexp_matches(text, '{URL}') AS url, regexp_matches(text, '{flat(R.phone)}') AS phone, {is_amount('text', 'k')} AS amount, {count('text', flat(R.suffix))} AS suffixes,
  {NOISE} AS noise, {penalty('text', 'k')} AS penalty, {TOKENS} AS tokens, {meta('text', 'k')} AS meta, {sql_advert('text')} AS advert, {LABEL} AS label FROM l0),
l2 AS (SELECT *, {caution_of('text', 'k')} AS caution, len(list_filter(tokens, lambda x: {like_name('x')})) AS good FROM l1),
l3 AS (SELECT *, len(tokens) >= 4 AND good >= 4 AND good / greatest(len(tokens), 1) >= 0.65 AS sequence FROM l2),
l4 AS (SELECT *, (n_separators >= 2 AND len(tokens) >= 3) OR (n_separators >= 1 AND len(tokens) >= 2) OR sequence OR (suffixes >= 2 AND NOT advert AND NOT meta) AS structure FROM l3),
l5 AS (SELECT *, {usage_of('text', 'k', 'structure')} AS usage, NOT noise AND NOT meta AND penalty < 2 AND NOT url AND NOT amount AND structure AS listed FROM l4),
l6 AS (SELECT *, {IMPLICIT} AS implicit, len(text) >= 2 AND NOT amount AND NOT url AND NOT listed AS sentence, {VALUE} AS value,
  k <> '' AND len(text) BETWEEN 2 AND 80 AND NOT noise AND NOT {has('k', _NAME_WORDS)} AND NOT amount AND NOT listed AND NOT url AND NOT phone AND penalty < 2 AND regexp_matches(text, '[가-힣A-Za-z]') AS name_like,
  1.0 + CASE WHEN len(text) BETWEEN 3 AND 45 THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '[가-힣]') THEN 0.2 ELSE 0 END - CASE WHEN meta THEN 1.3 ELSE 0 END
  - CASE WHEN amount THEN 1.2 ELSE 0 END - CASE WHEN listed THEN 1.8 ELSE 0 END - CASE WHEN usage THEN 1.4 ELSE 0 END - CASE WHEN caution THEN 1.4 ELSE 0 END - CASE WHEN url THEN 1.2 ELSE 0 END AS name_score,
  CASE WHEN meta OR usage OR caution OR amount OR url THEN -1.0 ELSE least(n_separators * 0.5, 3.0) + CASE WHEN len(tokens) >= 4 THEN 1 ELSE 0 END + CASE WHEN sequence THEN 1.5 ELSE 0 END + CASE WHEN len(text) >= 30 THEN 0.5 ELSE 0 END END AS list_score FROM l5),
facts AS MATERIALIZED (SELECT * FROM l6)"""
NAMES = """names AS (SELECT doc_id, line_index, text, name_score + greatest(0, 1.0 - line_index / greatest(low, 1)) AS score, pos FROM
  (SELECT *, max(line_index) OVER (PARTITION BY doc_id) AS low FROM facts) WHERE pos <= 10 AND name_like QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) = 1)"""
#: The walk, all documents a line at a time: what each line may do with the section that is going on.
_GOES_ON = (
    "CASE active WHEN 'ingredients' THEN NOT usage AND NOT caution AND NOT meta AND NOT url AND (structure OR n_separators >= 1 OR len(tokens) >= 2 OR gap < 3) WHEN 'usage' THEN NOT meta AND NOT listed AND NOT caution AND sentence "
    "WHEN 'cautions' THEN NOT listed AND NOT url AND sentence WHEN 'capacity' THEN NOT meta AND amount WHEN 'effects' THEN NOT meta AND NOT listed AND NOT url AND NOT amount AND sentence WHEN 'qr_url' THEN NOT meta AND url ELSE false END"
)
_WALKED = (
    "CASE WHEN label IS NOT NULL THEN label WHEN implicit IN ('ingredients', 'usage', 'cautions') THEN implicit WHEN implicit IS NOT NULL THEN active WHEN goes_on THEN active END AS active, "
    "CASE WHEN label IS NOT NULL OR implicit IN ('ingredients', 'usage', 'cautions') THEN 0 WHEN implicit IS NOT NULL THEN gap WHEN goes_on AND active = 'ingredients' THEN CASE WHEN structure THEN 0 ELSE gap + 1 END WHEN goes_on THEN gap ELSE 0 END AS gap, "
    "CASE WHEN label IS NOT NULL THEN CASE WHEN value <> '' THEN label END WHEN implicit IS NOT NULL THEN implicit WHEN goes_on THEN active END AS section"
)
WALK = f"""walk AS (SELECT doc_id, 0::BIGINT AS pos, NULL::VARCHAR AS active, 0 AS gap, NULL::VARCHAR AS section, 0::BIGINT AS line_index, ''::VARCHAR AS section_text FROM (SELECT DISTINCT doc_id FROM facts)
  UNION ALL SELECT doc_id, pos, {_WALKED}, line_index, CASE WHEN label IS NOT NULL THEN value ELSE text END FROM (SELECT f.*, w.active, w.gap, {_GOES_ON} AS goes_on FROM walk w JOIN facts f ON f.doc_id = w.doc_id AND f.pos = w.pos + 1)),
found AS MATERIALIZED (SELECT doc_id, section, line_index, section_text FROM walk WHERE section IS NOT NULL)"""
#: The best guesses for sections that a document lacks, then all other lines, then texts by section.
SECTIONED = f"""{NAMES},
amounts AS (SELECT doc_id, line_index, text FROM facts WHERE amount QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY 1 + CASE WHEN {has('k', R.capacity)} THEN 0.4 ELSE 0 END - CASE WHEN meta THEN 1 ELSE 0 END DESC, line_index) = 1),
marks AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) - 1 > 3 THEN 1 ELSE 0 END AS new FROM facts WHERE list_score > 0),
isles AS (SELECT doc_id, island, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marks) GROUP BY doc_id, island),
inside AS (SELECT f.*, island FROM facts f JOIN isles i ON i.doc_id = f.doc_id AND f.pos BETWEEN i.first AND i.last),
scored AS (SELECT doc_id, island, count(*) FILTER (WHERE structure) AS n, sum(CASE WHEN structure THEN 2.0 ELSE 0 END - CASE WHEN meta THEN 1.5 ELSE 0 END - CASE WHEN usage THEN 1 ELSE 0 END - CASE WHEN caution THEN 1 ELSE 0 END)
  + least(sum(n_separators) * 0.3, 3.0) + least(sum(len(text)) * 0.005, 2.0) AS score FROM inside GROUP BY doc_id, island),
best AS (SELECT doc_id, island FROM scored WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, island) = 1),
guesses AS (SELECT doc_id, line_index, text, 'product_name' AS section FROM names UNION ALL SELECT *, 'capacity' FROM amounts UNION ALL SELECT doc_id, line_index, text, 'ingredients' FROM inside JOIN best USING (doc_id, island)
  UNION ALL SELECT doc_id, line_index, text, 'qr_url' FROM facts WHERE url),
filled AS (SELECT * FROM found UNION ALL SELECT doc_id, section, line_index, text FROM guesses ANTI JOIN (SELECT DISTINCT doc_id, section FROM found) USING (doc_id, section)),
used AS (SELECT DISTINCT doc_id, section_text AS text, line_index FROM filled WHERE section <> 'others'),
every AS (SELECT * FROM filled UNION ALL SELECT doc_id, 'others', line_index, text FROM facts ANTI JOIN used USING (doc_id, text, line_index)),
firsts AS (SELECT doc_id, section, section_text, min(line_index) AS i FROM every GROUP BY ALL)"""

_RATES = """SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS matched, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN lower(l_linestatus) END) AS verified,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS unverified, round(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN lower(l_linestatus) END) / count(*) * 100, 6) AS match_rate,
  CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = count(*) THEN 'success' WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'partial_success' ELSE 'all_failed' END AS status
  FROM lineitem GROUP BY l_orderkey"""

_FIRST_KNOWN = KNOWN.format("value")


def list_steps(source: str) -> str:
    """list_text of (doc_id, x) for texts without Hangul or PEG numbers, where no name runs into another."""
    from ..functions.phrases import stop_words
    from ..rules import RAW

    steps = ["trim(regexp_replace(regexp_replace(x, '[^가-힣a-zA-Z0-9\\s,./·ㆍ;:+\\-()_%\\[\\]：]', ' ', 'g'), '\\s+', ' ', 'g'))"]
    chem = "translate(x, '，、；ㆍ：', ',,;·:')"
    for old, new in ((r"1\s*,?\s*2\s*-\s*", "1,2-"), (r"(\d)\s*[pP][pP][mM]", r"\1ppm"), (r"(?i)(피이지|PEG)\s*-?\s*(\d+)", r"\1-\2"), (r"(?i)(피피지|PPG)\s*-?\s*(\d+)", r"\1-\2"), (r"\s+", " ")):
        chem = f"regexp_replace({chem}, '{old}', '{new}', 'g')"
    label = "x"
    for w in RAW.ingredients:
        label = f"regexp_replace({label}, '(?i)^\\s*{_quoted(w)}\\s*[:：]?\\s*', '')"
    spots = "list_min(list_filter([" + ", ".join(f"instr(lower(x), '{w.lower()}')" for w in stop_words()) + "], lambda p: p > 1))"
    bare = "regexp_replace(w, '^[ ,.;:：/·ㆍ\\-()\\[\\]{}]+|[ ,.;:：/·ㆍ\\-()\\[\\]{}]+$', '', 'g')"
    noise = ", ".join(f"'{key_of(w)}'" for w in RAW.noise)
    commas = "translate(x, '，、；ㆍ：', ',,;·:')"
    for old, new in ((r"\s*,\s*", ", "), (r",\s*,+", ", "), (r"\s*;\s*", "; "), (r"\s+", " ")):
        commas = f"regexp_replace({commas}, '{old}', '{new}', 'g')"
    commas = f"trim({commas}, ' ,;:')"
    steps += [f"trim({chem})", f"trim({label})", f"CASE WHEN {spots} IS NULL THEN x ELSE trim(substr(x, 1, {spots} - 1)) END", f"array_to_string(list_filter(string_split(x, ' '), lambda w: {bare} <> '' AND {key(bare)} NOT IN ({noise})), ' ')", commas, commas]
    for step in steps:
        source = f"(SELECT doc_id, {step} AS x FROM {source})"
    return source


_RESULTS = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_returnflag = 'R' AS matched, 'Name ' || l_linestatus || (l_partkey % 2) AS name, 'part ' || l_partkey AS ocr FROM lineitem)"
_MATCHED = f"""(SELECT l_orderkey, count(*) AS total_count, count(*) FILTER (WHERE matched) AS success_count, count(*) FILTER (WHERE NOT matched) AS failed_count, count(DISTINCT CASE WHEN matched THEN name END) AS normalized_count,
  CASE WHEN count(*) = count(*) FILTER (WHERE matched) THEN 'success' WHEN count(*) FILTER (WHERE matched) > 0 THEN 'partial_success' ELSE 'all_failed' END AS status,
  coalesce(any_value(n.names), '') AS names, coalesce(string_agg(ocr, ',' ORDER BY i) FILTER (WHERE NOT matched), '') AS unverified
  FROM {_RESULTS} LEFT JOIN (SELECT l_orderkey, string_agg(name, ',' ORDER BY f) AS names FROM (SELECT l_orderkey, name, min(i) AS f FROM {_RESULTS} WHERE matched GROUP BY ALL) GROUP BY l_orderkey) n USING (l_orderkey) GROUP BY l_orderkey)"""

SQL = {
    "line_section_counts": f"SELECT lang, coalesce({LABEL}, 'none') AS label, {NOISE} AS noise, count(*) AS n_lines, sum(len(text))::BIGINT AS n_chars FROM (SELECT *, {key('text')} AS k FROM {LINES}) GROUP BY ALL",
    "separator_profile": f"""SELECT doc_id, sum(s)::BIGINT AS separators, sum(t)::BIGINT AS tokens, count(*) FILTER (WHERE (s >= 2 AND t >= 3) OR (s >= 1 AND t >= 2)) AS list_lines
        FROM (SELECT doc_id, {SEPARATORS.format('text')} AS s, len({TOKENS}) AS t FROM {LINES}) GROUP BY doc_id""",
    "ordered_distinct_tokens": """SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, md5(coalesce(words, '')) AS words_md5 FROM documents d LEFT JOIN
        (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS ws FROM documents))
          WHERE w <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) = 1) GROUP BY doc_id) x USING (doc_id)""",
    "sentinel_coalesce": f"""SELECT conv_id, CASE WHEN {KNOWN.format("arg_min(coalesce(value, ''), turn)")} THEN trim(arg_min(value, turn)) ELSE '{UNKNOWN}' END AS first_value,
        coalesce(arg_min(trim(value), turn) FILTER (WHERE {_FIRST_KNOWN}), '-') AS first_role, count(DISTINCT lower(trim(value))) FILTER (WHERE {_FIRST_KNOWN}) AS n_known
        FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' N/A ' WHEN turn % 3 = 1 THEN role END AS value FROM conversations) GROUP BY conv_id""",
    "amount_mentions": f"SELECT lang, count(*) FILTER (WHERE {is_amount('line', key('line'))}) AS n_amounts, count(*) AS n_lines FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang",
    "url_normalise": f"SELECT page_id, {WITH_SCHEME} AS url, translate(b, '\\/:*?\"<>| ', '__________') AS file_name, regexp_matches(url, '{URL}') AS is_url FROM (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS b FROM pages)",
    "html_titles": f"SELECT page_id, {HTML_TITLE} AS title, {DESCRIPTION} AS description FROM pages",
    "fetched_page_status": f"SELECT coalesce(html, '') <> '' AS success, CASE WHEN coalesce(html, '') <> '' THEN 200 END AS status_code, count(*) AS n, count(DISTINCT {HTML_TITLE}) AS titles FROM pages GROUP BY ALL",
    "query_variants": f"""SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS variants FROM (SELECT p_partkey, v, min(i) AS i FROM
        (SELECT p_partkey, {query('x')} AS v, i FROM (SELECT p_partkey, unnest(list_concat([b, replace(b, '-', ''), replace(b, ',', ''), CASE WHEN regexp_matches(b, '(?i)[0-9]+ppm') THEN regexp_replace(b, '(?i)[0-9]+ppm', '', 'g') END, replace(b, '/', '')],
          CASE WHEN contains(b, '/') THEN string_split(b, '/') ELSE [] END)) AS x, unnest(range(20)) AS i
          FROM (SELECT p_partkey, {query("concat_ws('/', p_name, p_brand, p_size::VARCHAR || ' ppm')")} AS b FROM part)) WHERE x IS NOT NULL) WHERE len(v) > 1 GROUP BY p_partkey, v QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY min(i)) <= 8) GROUP BY p_partkey""",
    "quality_score": f"""SELECT doc_id, round(CASE WHEN text = '' THEN 0 ELSE greatest(0.9 + len(regexp_replace(text, '[^가-힣A-Za-z0-9,.;:()\\[\\]/\\-·%]', '', 'g')) / greatest(len(text), 1) * 0.35
        + least(len(string_split(text, ' ')) * 0.003, 0.3) + least(len(string_split(text, chr(10))) * 0.01, 0.3) + 0.03
        + CASE WHEN {has('k', R.product + R.capacity + R.ingredients + R.usage + R.cautions)} THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '{AMOUNT}') THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(text, '{URL}') THEN 0.05 ELSE 0 END
        + CASE WHEN ({count('text', ',')} >= 3 AND len(regexp_split_to_array(text, '\\s+')) >= 6) OR {count('text', flat(R.suffix))} >= 2 THEN 0.18 ELSE 0 END
        - CASE WHEN len(trim(text, ' ')) < 10 THEN 0.3 ELSE 0 END - CASE WHEN len(string_split(text, chr(10))) < 3 THEN 0.2 ELSE 0 END
        - least((len(text) - len(translate(text, '�□■◆◇', '')) + {count('text', '[Yy]{2,}')} + {count('text', '[UuDdOoLlIi]{4,}')}) * 0.06, 0.6), 0) END, 6)::DOUBLE AS score FROM (SELECT doc_id, text, {key('text')} AS k FROM documents)""",
    "penalty_score": f"SELECT lang, sum({penalty('line', key('line'))})::BIGINT AS penalty, count(*) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang",
    "keyword_cut": """SELECT doc_id, len(cut)::BIGINT AS n_kept, md5(cut) AS kept_md5 FROM (SELECT doc_id, CASE WHEN spot IS NULL THEN text ELSE regexp_replace(substr(text, 1, spot - 1), '^\\s+|\\s+$', '', 'g') END AS cut
        FROM (SELECT doc_id, text, list_min(list_filter([instr(lower(text), 'the'), instr(lower(text), 'der'), instr(lower(text), 'que'), instr(lower(text), 'los')], lambda p: p > 1)) AS spot FROM documents))""",
    "anti_fill_others": f"""WITH l AS (SELECT *, {SEPARATORS.format('text')} >= 2 AS hit FROM {LINES}) SELECT doc_id, 'ingredients' AS section, count(*) AS n FROM l WHERE hit GROUP BY doc_id
        UNION ALL SELECT doc_id, 'others', count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM l u WHERE u.hit AND u.doc_id = l.doc_id AND u.text = l.text AND u.line_index = l.line_index) GROUP BY doc_id""",
    "line_islands": f"""WITH h AS (SELECT doc_id, line_index FROM {LINES} WHERE {SEPARATORS.format('text')} > 0), g AS (SELECT *, CASE WHEN line_index - lag(line_index) OVER w - 1 > 1 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_index) AS island FROM g) SELECT doc_id, island::BIGINT AS island, min(line_index)::BIGINT AS first, max(line_index)::BIGINT AS last FROM s GROUP BY doc_id, island""",
    "gap_threshold": """WITH g AS (SELECT user_id, y - lag(y) OVER (PARTITION BY user_id ORDER BY y, event_id) AS gap FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS y FROM events)),
        s AS (SELECT user_id, list_sort(list(gap) FILTER (WHERE gap > 0)) AS gaps FROM g GROUP BY user_id)
        SELECT user_id, round(CASE WHEN gaps IS NULL OR len(gaps) = 0 THEN 2.0 ELSE greatest(gaps[least(floor(len(gaps) * 0.75)::INT, len(gaps) - 1) + 1] * 1.5, 1.5) END, 3) AS threshold FROM s""",
    "merge_by_conversation": f"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations),
        n AS (SELECT conv_id, count(*) AS n, string_agg(x, chr(10) ORDER BY turn, i) AS t FROM (SELECT conv_id, turn, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM l WHERE {KNOWN.format('x')}
          QUALIFY row_number() OVER (PARTITION BY conv_id, translate(lower(trim(x)), ' ' || chr(10) || chr(13) || chr(9), '') ORDER BY turn, i) = 1) GROUP BY conv_id),
        b AS (SELECT conv_id, string_agg(x, chr(10) || chr(10) ORDER BY turn) AS t FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM conversations WHERE {KNOWN.format('text')}
          QUALIFY row_number() OVER (PARTITION BY conv_id, translate(lower(trim(text)), ' ' || chr(10) || chr(13) || chr(9), '') ORDER BY turn) = 1) GROUP BY conv_id)
        SELECT c.conv_id, count(*) AS n_images, arg_min(role, turn) AS role, any_value(coalesce(n.n, 0))::BIGINT AS n_lines, any_value(md5(coalesce(n.t, ''))) AS lines_md5, any_value(md5(coalesce(b.t, ''))) AS body_md5, round(coalesce(avg(CASE WHEN len(text) > 0 THEN len(text) / 1000 END), 0), 6) AS confidence
        FROM conversations c LEFT JOIN n USING (conv_id) LEFT JOIN b USING (conv_id) GROUP BY c.conv_id""",
    "top_line_per_document": f"WITH {FACTS}, {NAMES} SELECT doc_id, line_index::BIGINT AS line_index, round(score, 6)::DOUBLE AS score FROM names",
    "section_walk": f"WITH RECURSIVE {FACTS}, {WALK} SELECT doc_id, section, count(*) AS n FROM found GROUP BY ALL",
    "sectioned_documents": f"""WITH RECURSIVE {FACTS}, {WALK}, {SECTIONED} SELECT doc_id, section, count(*) AS n_texts,
        md5(CASE WHEN section IN ('usage', 'cautions', 'effects', 'others') THEN string_agg(section_text, chr(10) ORDER BY i) ELSE string_agg(section_text, ' ' ORDER BY i) END) AS text_md5 FROM firsts GROUP BY doc_id, section""",
    "line_clusters": """WITH RECURSIVE b AS (SELECT l_orderkey AS o, l_linenumber * 60.0::DOUBLE AS x, (l_quantity % 7) * 18.0::DOUBLE + l_discount * 40 + 7 AS y, 'w' || l_partkey AS text FROM lineitem),
        s AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY y, x, text) AS pos FROM b),
        walk AS (SELECT o, pos, 0 AS line, y AS total, 1 AS n, x, y, text FROM s WHERE pos = 1
          UNION ALL SELECT s.o, s.pos, CASE WHEN opens THEN line + 1 ELSE line END, CASE WHEN opens THEN s.y ELSE total + s.y END, CASE WHEN opens THEN 1 ELSE n + 1 END, s.x, s.y, s.text
          FROM (SELECT w.o, w.pos, w.line, w.total, w.n, s.y - w.total / w.n > 7.7 AS opens FROM walk w JOIN s ON s.o = w.o AND s.pos = w.pos + 1) w JOIN s ON s.o = w.o AND s.pos = w.pos + 1),
        m AS (SELECT *, lag(x) OVER (PARTITION BY o, line ORDER BY x, text) AS before FROM walk)
        SELECT o::VARCHAR AS image_id, line::BIGINT AS line_index, string_agg(CASE WHEN x - before - 50 >= 3 THEN ' ' ELSE '' END || text, '' ORDER BY x, text) AS text, count(*) AS n_blocks, round(avg(y), 6) AS center_y FROM m GROUP BY o, line""",
    "suppressed_boxes": """WITH RECURSIVE b AS (SELECT l_orderkey AS o, l_returnflag AS t, l_linenumber * 2 AS y, 1.0 - l_discount AS c, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount, l_linenumber) AS pos FROM lineitem),
        walk AS (SELECT o, t, pos, [y] AS chosen, c AS best FROM b WHERE pos = 1
          UNION ALL SELECT b.o, b.t, b.pos, CASE WHEN len(list_filter(chosen, lambda v: (40 - abs(v - b.y)) / (40 + abs(v - b.y)) >= 0.75)) > 0 THEN chosen ELSE list_append(chosen, b.y) END, best FROM walk w JOIN b ON b.o = w.o AND b.t = w.t AND b.pos = w.pos + 1)
        SELECT o AS image_index, t AS section_type, len(arg_max(chosen, pos))::BIGINT AS kept, any_value(best)::DOUBLE AS best FROM walk GROUP BY o, t""",
    "match_rates": _RATES,
    "exact_matches": """SELECT query, min(i) AS item_pos, 1.0::DOUBLE AS score FROM (SELECT DISTINCT upper(replace(p_name, ' ', '-')) AS query, replace(lower(p_name), ' ', '') AS k FROM part) JOIN (SELECT p_partkey AS i, replace(lower(p_name), ' ', '') AS k FROM part) USING (k) GROUP BY query""",
    "word_boxes": """SELECT l_orderkey::VARCHAR AS image_id, l_linenumber::BIGINT AS ord, x AS x_min, x + 50 AS x_max, round(y, 6) AS y_min, round(y + 7, 6) AS center_y, 50.0::DOUBLE AS width, 14.0::DOUBLE AS height
        FROM (SELECT *, (l_linenumber * 60)::DOUBLE AS x, (l_quantity % 7) * 18 + l_discount * 40 AS y FROM lineitem)""",
    "box_overlaps": """WITH b AS (SELECT l_orderkey, l_linenumber, greatest(least((l_quantity * 4)::INT, 240), 0) AS x1, greatest(least(l_linenumber * 10, 90), 0) AS y1, least((l_quantity * 4 + 60)::INT, 240) AS x2, least(l_linenumber * 10 + 30, 90) AS y2 FROM lineitem),
        p AS (SELECT l_orderkey, l_linenumber, greatest(x1 - 8, 0) AS x1, greatest(y1 - 8, 0) AS y1, least(x2 + 8, 240) AS x2, least(y2 + 8, 90) AS y2 FROM b WHERE x2 - x1 >= 5 AND y2 - y1 >= 5),
        j AS (SELECT a.l_orderkey, a.l_linenumber, greatest(least(a.x2, n.x2) - greatest(a.x1, n.x1), 0) * greatest(least(a.y2, n.y2) - greatest(a.y1, n.y1), 0) AS o, (a.x2 - a.x1) * (a.y2 - a.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) AS s
          FROM p a JOIN p n ON n.l_orderkey = a.l_orderkey AND n.l_linenumber = a.l_linenumber + 1)
        SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN s - o > 0 THEN o / (s - o) ELSE 0 END, 6)::DOUBLE AS iou FROM j""",
    "two_source_merge": f"""SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang, '{UNKNOWN}') AS product_name,
        CASE WHEN l.doc_id IS NULL THEN source || ',' || lang WHEN doc_id % 4 / 4 >= 0.55 OR d.doc_id IS NULL THEN toxic::VARCHAR ELSE toxic::VARCHAR || ',' || source || ',' || lang END AS usage,
        'product_name: ' || CASE WHEN quality = 1 AND doc_id % 10 / 10 >= 0.6 THEN 'second sure' WHEN quality = 1 AND d.doc_id IS NULL THEN 'second only' WHEN d.doc_id IS NOT NULL AND coalesce(quality, 0) <> 1 THEN 'first only' WHEN quality = 1 THEN 'both' ELSE 'none' END
        || '; usage: ' || CASE WHEN l.doc_id IS NOT NULL AND doc_id % 4 / 4 >= 0.55 THEN 'second sure' WHEN d.doc_id IS NULL THEN 'second only' WHEN l.doc_id IS NULL THEN 'first only' ELSE 'both' END AS reasons
        FROM documents d FULL JOIN labels l USING (doc_id)""",
    "override_merge": "SELECT doc_id, CASE WHEN quality = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN quality = 0 THEN CASE WHEN source = 'src0' THEN 'src0,new' ELSE source || ',src0,new' END ELSE source END AS links FROM documents LEFT JOIN labels USING (doc_id)",
    "lenient_json": "SELECT event_id, nullif(trim(props ->> '$.k'), '') AS k FROM events",
    "catalogue_items": "SELECT p_partkey, 0::BIGINT AS item_pos, p_name AS kor_name, p_brand AS eng_name FROM part",
    "request_images": """SELECT page_id::VARCHAR AS user_id, 0::BIGINT AS image_index, 'http://x/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.PNG?s=1' ELSE '.bin' END AS url, CASE WHEN page_id % 2 = 0 THEN '01.png' ELSE '01.jpg' END AS file_name,
        CASE WHEN page_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS media_type FROM pages WHERE page_id % 3 <> 2""",
    "inline_segments": r"""WITH t AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations),
        p AS (SELECT regexp_split_to_array(x, '(?i)that|with|avec|pour|nicht|para') AS bs, regexp_extract_all(x, '(?i)that|with|avec|pour|nicht|para') AS ls FROM t),
        s AS (SELECT unnest(bs) AS b, unnest(list_concat([''], ls)) AS l FROM p),
        c AS (SELECT CASE lower(l) WHEN '' THEN 'none' WHEN 'that' THEN 'usage' WHEN 'para' THEN 'usage' WHEN 'with' THEN 'cautions' WHEN 'avec' THEN 'cautions' ELSE 'effects' END AS section, regexp_replace(b, '^[ :,.;·ㆍ\[\]()\n\t]+|[ :,.;·ㆍ\[\]()\n\t]+$', '', 'g') AS body FROM s)
        SELECT section, count(*) AS n, sum(len(body))::BIGINT AS n_chars FROM c WHERE body <> '' GROUP BY section""",
    "payload_projection": f"""SELECT o_orderkey::VARCHAR AS user_id, CASE WHEN {KNOWN.format('o_orderpriority')} THEN trim(o_orderpriority) ELSE '{UNKNOWN}' END AS product_name, coalesce(verified, 0) AS ingredient_verified_count, coalesce(total, 0) AS ingredient_total_count,
        coalesce(status, 'no_candidates') AS ingredient_api_status FROM orders LEFT JOIN ({_RATES}) r ON l_orderkey = o_orderkey""",
    "list_texts": f"SELECT doc_id, len(x)::BIGINT AS n_chars, md5(x) AS text_md5 FROM {list_steps('(SELECT doc_id, text AS x FROM documents)')}",
    "amount_texts": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size || 'g' WHEN 1 THEN '3ml / ' || p_size || ' x 3ml' ELSE '' END AS amount FROM part",
    "mended_links": f"""WITH t AS (SELECT page_id, 'see http://' || regexp_replace(url, '^https?://', '') || ' , and www.site' || page_id || '.com/x.' AS t FROM pages),
        f AS (SELECT page_id, list_transform(list_concat(regexp_extract_all(t, '(?i)https?://\\S+'), regexp_extract_all(t, '(?i)www\\.\\S+'), regexp_extract_all(t, '(?i)[a-zA-Z0-9.-]+\\.(?:{LINK_ENDS})\\S*')), lambda x: trim(x, ' ,.;:()[]{{}}<>')) AS ls FROM t)
        SELECT page_id, len(list_distinct(list_transform(ls, lambda x: lower(x))))::BIGINT AS n_links, ls[1] AS first_link FROM f""",
    "match_records": f"SELECT * FROM {_MATCHED}",
    "flat_payloads": f"""SELECT o_orderkey AS user_id, trim(o_orderpriority) AS product_name, '{UNKNOWN}' AS capacity, coalesce(names, '') AS ingredients, 'raw' AS raw_text, '' AS usage, trim(o_orderpriority) AS cautions, '' AS effects,
        round(o_custkey % 7 / 7.0::DOUBLE, 4) AS ocr_confidence, '2024-01-01 00:00:00' AS analyzed_at, round(coalesce(normalized_count / total_count * 100, 0), 2)::DOUBLE AS ingredient_match_rate, coalesce(normalized_count, 0) AS ingredient_verified_count,
        coalesce(total_count, 0) AS ingredient_total_count, o_orderstatus || ',' || trim(o_orderpriority) AS ingredients_raw, coalesce(unverified, '') AS unverified_ingredients, coalesce(status, 'not_run') AS ingredient_api_status,
        CASE WHEN o_orderkey % 2 = 0 THEN 'www.x.com/' || o_orderkey || ',code' ELSE '' END AS qr_codes, CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.x.com/' || o_orderkey ELSE '' END AS qr_urls
        FROM orders LEFT JOIN {_MATCHED} ON l_orderkey = o_orderkey""",
    "stored_payloads": f"""SELECT o_orderkey AS user_id, trim(o_orderpriority) AS product_name, CASE WHEN o_orderkey % 2 = 0 THEN 'www.x.com/' || o_orderkey || ',code' ELSE '{UNKNOWN}' END AS qr_codes, coalesce(status, 'not_run') AS status,
        coalesce(total_count, 0) AS total, '{UNKNOWN}' AS capacity FROM orders LEFT JOIN {_MATCHED} ON l_orderkey = o_orderkey""",
    "matching_keys": f"SELECT lang, count(DISTINCT {key('line')}) AS n_keys, count(DISTINCT line) AS n_lines FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang",
    "glyph_texts": f"SELECT p_partkey, {clean_recognised('x')} AS text FROM (SELECT p_partkey, '▶ ★' || p_name || ' ， Ⅲ → (' || p_size || ' ㎕ ) ；５％ • “' || p_brand || '” ＆ Ⅳ／２㎍' || chr(9) || '☆' AS x FROM part)",
    "distinct_variants": """SELECT DISTINCT ON (l_orderkey, l_returnflag, l_linestatus) l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_returnflag, 'N') AS variant, l_linestatus AS path
        FROM lineitem ORDER BY l_orderkey, l_returnflag, l_linestatus, l_linenumber, l_partkey, l_suppkey""",
    "line_keys": f"SELECT lang, count(DISTINCT {key('line')}) AS n_keys, count(DISTINCT translate(lower(line), ' ' || chr(10) || chr(13) || chr(9), '')) AS n_spaceless, count(DISTINCT line) AS n_lines FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang",
    "request_flow": f"""WITH i AS (SELECT o_orderkey AS k, n FROM orders, range(4) r(n) WHERE n < o_custkey % 5),
        l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
        f AS (SELECT k, n, part.*, CASE WHEN p_partkey % 4 = 0 THEN 'Qzxwv Jkq' || p_size ELSE p_name END AS name FROM i JOIN l ON l_orderkey = k AND l_linenumber = n + 1 JOIN part ON p_partkey = p WHERE (l_orderkey + l_linenumber) % 6 <> 0),
        m AS (SELECT k, count(*) AS n_analysed, arg_min(p_brand, n) FILTER (WHERE p_size % 3 > 0) AS brand, count(DISTINCT name) AS n_names, count(DISTINCT name) FILTER (WHERE p_partkey % 4 <> 0) AS n_verified,
          coalesce(avg(p_size / 50.0::DOUBLE) FILTER (WHERE p_size > 0), 0) AS confidence FROM f GROUP BY k),
        u AS (SELECT k, string_agg('https://www.x.com/' || p, ',' ORDER BY n) AS urls FROM (SELECT k, p_partkey AS p, min(n) AS n FROM f GROUP BY ALL) GROUP BY k),
        s AS (SELECT k, string_agg(t, ',' ORDER BY n) AS usage FROM (SELECT k, p_type AS t, min(n) AS n FROM f GROUP BY ALL) GROUP BY k)
        SELECT o_orderkey AS user_id, CASE WHEN m.k IS NOT NULL THEN CASE WHEN o_orderstatus = 'F' THEN 'answered' ELSE coalesce(brand, '{UNKNOWN}') END END AS product_name,
        CASE WHEN m.k IS NOT NULL THEN CASE WHEN o_orderstatus = 'F' THEN '10 ml' ELSE '{UNKNOWN}' END END AS capacity, CASE WHEN m.k IS NOT NULL THEN CASE WHEN o_orderstatus = 'F' THEN 'use' ELSE usage END END AS usage,
        CASE WHEN m.k IS NOT NULL THEN o_custkey % 5 END AS n_images, n_analysed, n_names, n_verified, round(n_verified / n_names * 100, 6)::DOUBLE AS match_rate, round(confidence, 6)::DOUBLE AS confidence,
        CASE WHEN n_verified = n_names THEN 'success' WHEN n_verified > 0 THEN 'partial_success' WHEN n_names > 0 THEN 'all_failed' END AS status, urls,
        CASE WHEN o_custkey % 5 = 0 THEN 'request' WHEN m.k IS NULL THEN 'images' END AS stage, CASE WHEN o_custkey % 5 = 0 THEN 'no image_url' WHEN m.k IS NULL THEN 'no image could be analysed' END AS error
        FROM orders LEFT JOIN m ON m.k = o_orderkey LEFT JOIN u ON u.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""",
    "split_names": f"""SELECT p_partkey, {splittable("'전성분：' || p_name || '，' || chr(9) || p_brand || ' ㆍ 5㎖' || chr(13) || chr(10) || ' 2ｇ ; x–y  z' || chr(13) || p_type")} AS list,
        {plain_name("' (성분 : Ingredients - ' || p_name || '  2 ]，' || p_type || '。)/'")} AS name FROM part""",
    "variant_places": """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS place, l_returnflag AS variant, l_linestatus AS path, score, l_linenumber::BIGINT AS n_blocks, 0::BIGINT AS n_lines, l_linenumber::BIGINT AS text_length
        FROM (SELECT *, CASE WHEN l_quantity > 5 THEN floor(l_quantity / 10) / 10 ELSE 0 END::DOUBLE AS score FROM lineitem)""",
}
__all__ = ["SQL", "INVALID_CANDIDATES"]

SQL["page_texts"] = """WITH l AS (SELECT l_orderkey, (l_quantity * 10 + l_linenumber)::DOUBLE AS y, l_linenumber::DOUBLE AS x, 'w' || l_partkey AS t FROM lineitem),
    g AS (SELECT *, y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY y, x) AS gap FROM l),
    b AS (SELECT l_orderkey, list(gap ORDER BY gap) FILTER (WHERE gap > 0) AS gs FROM g GROUP BY l_orderkey),
    c AS (SELECT l_orderkey, CASE WHEN gs IS NULL THEN 24.0 ELSE greatest(gs[least(floor(len(gs) * 0.75)::BIGINT, len(gs) - 1) + 1] * 1.5, 18.0) END AS threshold FROM b)
    SELECT l_orderkey, md5(string_agg(t, chr(10) ORDER BY y, x, t)) AS raw_md5, replace(string_agg(CASE WHEN gap > threshold THEN chr(10) || t ELSE t END, chr(10) ORDER BY y, x, t), chr(10), '|') AS layout_text
    FROM g JOIN c USING (l_orderkey) GROUP BY l_orderkey"""

SQL["projected_answers"] = f"""WITH e AS (SELECT event_id, event_id % 8 AS s, props->>'$.k' AS k FROM events)
    SELECT event_id, s < 6 AS success, CASE WHEN s IN (0, 1, 5) THEN 'P' || k ELSE '{UNKNOWN}' END AS product_name,
        CASE s WHEN 0 THEN 'a' || k || '|b' WHEN 2 THEN 'a' WHEN 3 THEN 'i' || k WHEN 4 THEN 'a|7' ELSE '' END AS ingredients, CASE s WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 1::DOUBLE END AS confidence,
        CASE s WHEN 2 THEN 'product_name text {{"ko":"P' || k || '"}}' WHEN 4 THEN 'ingredients list ["a",{{"name":"b' || k || '"}},7]; confidence number "high"' ELSE '' END AS misfits,
        CASE s WHEN 6 THEN 'no JSON object' WHEN 7 THEN 'no answer' END AS error FROM e"""

SQL["repaired_pages"] = """WITH p AS (SELECT page_id, regexp_replace(translate(lower(html), 'abcdefghijklmnopqrstuvwxyz', '가나다라마바사아자차카타파하거너더러머버서어저처커터'), '[^가-힣 -~]', '', 'g') AS x FROM pages)
    SELECT page_id, len(x)::BIGINT AS n_chars, md5(x) AS text_md5, CASE page_id % 2 WHEN 1 THEN 'euc-kr' ELSE 'utf-8' END AS charset FROM p"""

SQL["stage_metrics"] = """SELECT 0 AS position, 'requests' AS stage, count(*) AS n_rows, count(*) FILTER (WHERE page_id % 5 < 2) AS n_errors, true AS done FROM pages
    UNION ALL SELECT 1, 'images', 2 * count(*) FILTER (WHERE page_id % 5 >= 2), 0, true FROM pages
    UNION ALL SELECT 2, 'pages', count(*), count(*) FILTER (WHERE page_id % 7 = 0 OR coalesce(html, '') = ''), true FROM pages"""

SQL["cached_lookups"] = """SELECT lower(p_name) AS name, len(p_name)::INTEGER AS length, lower(p_name)[1] AS first, CASE WHEN count(*) FILTER (WHERE p_partkey % 50 = 0) > 0 THEN 1 ELSE 2 END AS asked_in, 0 AS asked_last FROM part GROUP BY ALL"""

SQL["request_sessions"] = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, (props->>'$.k')::INTEGER % 6 AS i, user_id % 3 + 2 AS n FROM events),
    s AS (SELECT user_id, min(us) AS first FROM e GROUP BY user_id
          UNION ALL SELECT e.user_id, min(e.us) AS first FROM s JOIN e ON e.user_id = s.user_id AND e.us > s.first + 172800000000 GROUP BY e.user_id, s.first),
    p AS (SELECT user_id, first, n, i, min(us) AS us FROM s JOIN e USING (user_id) WHERE us BETWEEN first AND first + 172800000000 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, first ORDER BY us, i) AS k, count(*) OVER (PARTITION BY user_id, first) AS c FROM p),
    t AS (SELECT user_id, first, n, least(any_value(c), n) AS received, max(us) FILTER (WHERE k <= n) AS last, lead(first) OVER (PARTITION BY user_id ORDER BY first) AS next FROM r GROUP BY user_id, first, n)
    SELECT user_id::VARCHAR AS request_id, first AS first_us, last AS last_us, n::BIGINT AS n_images, received::BIGINT AS received, CASE WHEN received >= n THEN 'complete' ELSE 'timed out' END AS outcome
    FROM t WHERE received >= n OR next IS NOT NULL OR (first + 172800000000) // 1000 < (SELECT max(us) FROM e) // 1000 - 3600000"""


def commas_in_turn(x: str, words: tuple[str, ...], after: bool) -> str:
    """A comma at each of the words in turn, as the rule says it; twice each, since a match takes the character beside it along."""
    for w in words:
        for _ in range(2):
            x = f"regexp_replace({x}, '({w})([가-힣A-Za-z0-9])', '\\1, \\2', 'g')" if after else f"regexp_replace({x}, '([가-힣a-zA-Z0-9])({w})', '\\1, \\2', 'g')"
    return x


def list_steps_of_labels(source: str) -> str:
    """list_steps with the commas that names which run together ask for, before the last step."""
    # The outermost step evens the commas: the new ones come before it.
    last, inner = list_steps(source).removeprefix("(SELECT doc_id, ").removesuffix(")").split(" AS x FROM ", 1)
    ends = "CASE WHEN contains(x, ',') THEN x ELSE " + f"regexp_replace(regexp_replace({commas_in_turn('x', NAME_ENDS, True)}, '(?i)(피이지-?\\d+[A-Za-z]*)([가-힣])', '\\1, \\2', 'g'), '(?i)(PEG-?\\d+[A-Za-z]*)([A-Za-z가-힣])', '\\1, \\2', 'g') END"
    starts = f"CASE WHEN len(x) - len(replace(x, ',', '')) >= 3 THEN x ELSE {commas_in_turn('x', NAME_STARTS, False)} END"
    for step in (ends, starts, last):
        inner = f"(SELECT doc_id, {step} AS x FROM {inner})"
    return inner


for _new, _old in (("label_line_counts", "line_section_counts"), ("label_walk", "section_walk"), ("label_sections", "sectioned_documents"), ("label_top_lines", "top_line_per_document"), ("label_penalties", "penalty_score"), ("label_scores", "quality_score")):
    SQL[_new] = over_labels(SQL[_old])
SQL["label_lists"] = over_labels(f"SELECT doc_id, len(x)::BIGINT AS n_chars, md5(x) AS text_md5 FROM {list_steps_of_labels('(SELECT doc_id, text AS x FROM documents)')}")

SQL["located_sections"] = """WITH s AS (SELECT *, CASE l_partkey % 7 WHEN 0 THEN 'product_name' WHEN 1 THEN 'usage' WHEN 2 THEN 'cautions' WHEN 3 THEN 'qr_url' WHEN 5 THEN 'ingredients' WHEN 6 THEN 'capacity' END AS t, l_quantity::INTEGER * 4 AS x FROM lineitem),
    k AS (SELECT *, CASE WHEN t IS NOT NULL THEN t WHEN l_suppkey % 3 = 0 THEN 'cautions' END AS kind FROM s),
    b AS (SELECT *, greatest(least(x - 60, 120), 0) AS x1, greatest(least(x, 120), 0) AS x2 FROM k WHERE kind IS NOT NULL AND l_linenumber <= 4)
    SELECT l_orderkey, l_linenumber AS image_index, kind AS section_type, CASE WHEN l_suppkey % 3 = 0 THEN 'warnings' ELSE CASE kind WHEN 'product_name' THEN '제품명' WHEN 'capacity' THEN '용량' WHEN 'ingredients' THEN '전성분' WHEN 'usage' THEN '사용방법' WHEN 'cautions' THEN '주의사항' ELSE 'QR/URL' END END AS label, x1, 10 AS y1, x2, 40 AS y2, round(greatest(least((l_tax * 20)::DOUBLE, 1), 0), 6) AS confidence FROM b WHERE x2 - x1 >= 5"""
