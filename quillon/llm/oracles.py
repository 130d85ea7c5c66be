"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from quillon.llm import secrets, urls
from quillon.llm.quality import Risk

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
r as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from p)
select page_id, host, path, rule, case
  when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
  when {method} then 'block' else 'allow' end as verdict
from r
""".format(method=" or ".join(f"regexp_matches(host, '{r.pattern.replace(chr(92) + '0', ' ')}')" for r in urls.PATTERNS))

OP4 = rf"""
with d as (
  select row_number() over () as r, doc_id,
    list_filter(string_split_regex({LOWERED.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
b as (
  select cast(item_id as varchar) as item,
    list_filter(string_split_regex({LOWERED.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
win as (
  select item, least(len(w), 10) as n, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda i: list_slice(w, i, i + 9))) as win
  from b where len(w) > 0),
places as (
  select r, n, i, list_slice(w, i, i + n - 1) as win
  from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from win) where len(w) >= n)),
found as (select r, places.n, i, item from places join win on places.win = win.win and places.n = win.n),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as p from found) group by r),
its as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from found group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join its using (r)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lists(kind: str, pattern: str, group: int) -> str:
    p = _quoted(pattern)
    return f"string_split_regex(t, {p}) as gap_{kind}, regexp_extract_all(t, {p}) as hit_{kind}, regexp_extract_all(t, {p}, {group}) as size_{kind}"


def _spans(kind: str, least: int) -> str:
    """Structs of start, rank and end from what lies between the matches and in them."""
    rank = [*secrets.KINDS, "entropy"].index(kind)
    total = lambda name, end: f"cast(coalesce(list_sum(list_transform({name}_{kind}[1:{end}], lambda x: length(x))), 0) as bigint)"
    return f"""list_filter(list_transform(generate_series(1, len(hit_{kind})), lambda i: {{
      'start': {total("gap", "i")} + {total("hit", "i - 1")}, 'rank': {rank}, 'end': {total("gap", "i")} + {total("hit", "i")},
      'size': length(size_{kind}[i])}}), lambda s: s.size >= {least})"""


# RE2 folds letters beyond ASCII too, so the letters are spelled out.
_ASSIGN = secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
_P = secrets.Entropy()
_T = "list_transform(base, lambda s: ['assign', 'access', 'hex'][s.rank + 1] || ':' || s.start || ':' || s.end)"
_F = lambda c: f"(case when {c} > 1 then {c} * log2({c}) else 0.0 end)"

#: Here each window's entropy is computed afresh from its counts.
OP5 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
l as materialized (select *, {_lists("assign", _ASSIGN, 2)}, {_lists("access", "AKIA[A-Z0-9]{16,}", 0)}, {_lists("hex", "[0-9a-f]{24,}", 0)}, {_lists("entropy", _P.candidate, 0)} from d),
b as materialized (
  select r, doc_id, t, list_sort(list_concat({_spans("assign", 6)}, {_spans("access", 20)}, {_spans("hex", 24)})) as base, {_spans("entropy", 1)} as words
  from l),
c as (select r, unnest(words) as s, base, t from b),
k as (
  select r, s.start as pos, substr(t, s.start + 1, s.size) as word, base from c),
m as (
  select *, case when regexp_matches(word, '^([0-9a-f]+|[0-9A-F]+)$') then {_P.hex_bits} when regexp_matches(word, '^[A-Za-z0-9]+$') then {_P.alnum_bits} else {_P.base64_bits} end as bits
  from k where regexp_matches(word, '[0-9]') and regexp_matches(word, '[A-Za-z]') and {" and ".join(f"not regexp_matches(word, {_quoted(a)})" for a in _P.allow)}),
w as (select r, pos, bits, i, substr(word, cast(i as bigint), {_P.window}) as win from (select r, pos, bits, word, unnest(generate_series(1, length(word) - {_P.window} + 1)) as i from m) where not regexp_matches(win, {_quoted(_P.placeholder)})),
chars as (select r, pos, bits, i, substr(win, cast(j as bigint), 1) as ch from (select *, unnest(generate_series(1, {_P.window})) as j from w)),
h as (
  select r, pos, bits, i, sum({_F("n")}) as total from (select r, pos, bits, i, ch, count(*) as n from chars group by r, pos, bits, i, ch) group by r, pos, bits, i),
hot as (
  select r, pos, pos + min(i) - 1 as first, pos + max(i) - 1 + {_P.window} as last
  from h where total <= {_P.window} * (log2({_P.window}) - bits) + 1e-9 group by r, pos),
extra as (
  select r, list({{'start': cast(first as bigint), 'rank': 3, 'end': cast(last as bigint)}}) as spans
  from hot join m using (r, pos) where len(list_filter(base, lambda b: b.start <= first and b."end" >= last)) = 0
 group by r),
parts as (
  select doc_id, base, list_sort(list_concat(list_transform(base, lambda s: {{'start': s.start, 'rank': s.rank, 'end': s."end"}}), coalesce(spans, []))) as spans
  from b left join extra using (r))
select doc_id, cast(len(list_filter(base, lambda s: s.rank = 0)) as bigint) as n_assign, cast(len(list_filter(base, lambda s: s.rank = 1)) as bigint) as n_access,
  cast(len(list_filter(base, lambda s: s.rank = 2)) as bigint) as n_hex,
  sha256(array_to_string(list_transform(base, lambda s: ['assign', 'access', 'hex'][s.rank + 1] || ':' || s.start || ':' || s."end"), ',')) as base_sha256,
  array_to_string(list_transform(spans, lambda s: ['assign', 'access', 'hex', 'entropy'][s.rank + 1] || ':' || s.start || ':' || s."end"), ',') as spans
from parts
"""

_R = Risk()
_SHARE = _R.risk / len(_R.grid)
_WORD = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"
_CDF = "(case when {k} > n * {p} then 1.0 else list_sum(list_transform(generate_series(0, {k}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) end)"

OP7 = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
win as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(generate_series(1, len(w) - 2)) as i from d where len(w) > 2)),
twice as (select r, g from win group by r, g having count(*) > 1),
rep as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from win join twice using (r, g)) group by r),
f as (
  select r, doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length({_WORD.format("t")}) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines, coalesce(rep.n, 0) as n_repeat_words
  from d left join rep using (r)),
m as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    coalesce(n_symbols / nullif(word_chars, 0), 0) as symbol_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) as repeat_ratio, coalesce(word_chars / nullif(n_words, 0), 0) as mean_word
  from f),
good as (select doc_id from labels group by doc_id having min(quality) = 1 and max(quality) = 1),
held as (select * from m where not base_failed and doc_id in (select doc_id from good)),
counted as (select stratum, count(*) as n, {", ".join(f"cast(sum(cast({rule} > {c} as bigint)) as bigint) as {rule}_{j}" for rule, cuts in _R.grid.items() for j, c in enumerate(cuts))} from held group by stratum),
levels as (select *, {_R.error} / (count(*) over () * {_R.tests}) as lev from counted),
cuts as (
  select stratum, {", ".join("coalesce(" + ", ".join(f"case when {_CDF.format(k=f'{rule}_{j}', p=_SHARE)} <= lev then {c} end" for j, c in enumerate(cuts)) + f") as cut_{rule}" for rule, cuts in _R.grid.items())}
  from levels)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({" or ".join(f"coalesce({rule} > cut_{rule}, false)" for rule in _R.grid)}) as kept
from m left join cuts using (stratum)
"""

ORACLES = {"op3_url_filter": OP3, "op4_decontaminate": OP4, "op5_secrets": OP5, "op7_quality": OP7}
