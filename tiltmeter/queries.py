"""The queries of the audit operators on the driver's tables, and DuckDB SQL that computes the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.functions import columns as C
from tiltmeter.functions import numeric as N
from tiltmeter.operators import axes as X
from tiltmeter.operators import cells as K
from tiltmeter.operators import inference as I
from tiltmeter.operators import judges as J
from tiltmeter.operators import pool as P
from tiltmeter.operators import power as W
from tiltmeter.operators import prompts as R
from tiltmeter.operators import report as O
from tiltmeter.operators import resampling as D
from tiltmeter.operators import trials as T
from tiltmeter.sources import bridge as B
from tiltmeter.sources import files, manifests
from tiltmeter.sources import records as S
from tiltmeter.sources.files import working_folder
from tiltmeter.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Resamples of ``permutation_p_by_item``, ``results_table_text_by_item``, ``axes_left_outer_results_by_item`` and
#: ``bias_flags_by_item``, as their SQL has them. All other queries draw the operators' 10,000.
DRAWS, SIGNS = 40, 192
SIMS = 4000


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles at nine places, so that the last bits of functions don't count."""
    return df.select(*[(F.round(c, digits).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


# ---- SQL building blocks ---------------------------------------------------------------------------------------------


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def uni(*parts: str) -> str:
    return f"(('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"


def values(name: str, cols: str, rows) -> str:
    return f"(values {','.join('('+','.join(text(v) if isinstance(v, str) else str(v) for v in r)+')' for r in rows)}) {name}({cols})"


WS = r"[ \t\n\r\f\x0B]"
STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
SQUEEZE = lambda x: STRIP(f"regexp_replace({x}, '{WS}+', ' ', 'g')")
CUT = lambda rows: f"""(select *, substr(text, 1, head) as question, substr(text, head+1, first_) as correct, substr(text, head+first_+1) as wrong from
 (select *, floor((n-head) * (0.4::DOUBLE + 0.2::DOUBLE * {uni("'cut'", 'id')}))::BIGINT as first_ from (select *, length(text) as n, length(text)//5 as head from ({rows}))))"""  # noqa: E731
POOL = f"""pool as (select id, domain, question, correct, wrong, pos from
 {CUT("select 'd'||doc_id as id, lang as domain, text, doc_id as pos from documents where doc_id is not null and text is not null")})"""
ITEMS = POOL + ", items as (select id, domain, question, correct, wrong from pool where correct <> wrong)"
BIAS = "case axis " + " ".join(f"when '{a}' then {b}::DOUBLE" for a, b in B.BIAS.items()) + " end"
JUDGED = (
    ITEMS
    + f""", grid as (select id as item_id, judge_id, axis, condition, prompt_template, rep from items,
 {values('j', 'judge_id', [(j,) for j, _ in B.JUDGES])}, {values('a', 'axis', [(a,) for a in X.AXES])},
 {values('c', 'condition', [(c,) for c in T.CONDITIONS])}, {values('t', 'prompt_template', [(t,) for t in B.TEMPLATES])}, range({B.REPS}) r(rep)),
 keyed as (select *, concat_ws('|', item_id, axis, condition, judge_id, prompt_template, rep) as key from grid),
 drawn as (select *, case when {uni("'slot'", 'item_id')} < 0.5 then 'A' else 'B' end as preferred, {uni("'pf'", 'key')} as u,
  0.75::DOUBLE + 0.2::DOUBLE * ({uni("'q'", 'item_id')} - 0.5::DOUBLE)
  - case when condition='perturbed' and judge_id='hash-biased' then {BIAS} else 0::DOUBLE end as p_ok, {uni("'v'", 'key')} as v,
  floor({uni("'form'", 'key')} * 4) as form, floor({uni("'lat'", 'key')} * 50)::DOUBLE as latency_ms, {uni("'err'", 'key')} as e from keyed),
 judged as (select *, case when u < 0.02 then 'PARSE_FAIL' when u < 0.06 then (case when form = 3 then 'PARSE_FAIL' else 'TIE' end)
  when v < p_ok then preferred when preferred='A' then 'B' else 'A' end as verdict from drawn)"""
)
RIGHT = "(case when verdict = preferred then 1 else 0 end)"


def outcomes_sql() -> str:
    conds = ", ".join(f"max(case when condition='{c}' then {RIGHT} end) as {c}" for c in T.CONDITIONS)
    return f", outcomes as (select judge_id, axis, item_id, prompt_template, rep, {conds} from judged where verdict in ('A','B') group by all)"


def cells_sql(by: str) -> str:
    flips = lambda x, y, p: (
        f"sum(case when {x} is not null and {y} is not null then 1 else 0 end)::BIGINT as {p}n, "
        f"sum(case when {x}=1 and {y}=0 then 1 else 0 end)::BIGINT as {p}b, sum(case when {x}=0 and {y}=1 then 1 else 0 end)::BIGINT as {p}c"
    )
    inner = f"select {by}, item_id, {flips('base', 'perturbed', '')}, {flips('noise_a', 'noise_b', 'n')} from outcomes group by all"
    return outcomes_sql() + f", cells as (select * from ({inner}) where n > 0 or nn > 0)"


H = lambda a, b: f"(2*asin(sqrt(least(greatest({a},0),1))) - 2*asin(sqrt(least(greatest({b},0),1))))"
TOTALS = lambda by: f""", totals as (select {by}, count(*) as n_items, sum(n)::BIGINT as n, sum(b)::BIGINT as b, sum(c)::BIGINT as c
 from cells where n > 0 group by all), rates as (select *, (b-c)/n::DOUBLE as net_bias, (b+c)/n::DOUBLE as flip_rate, b/n::DOUBLE as p_wrong,
 c/n::DOUBLE as p_right, {H('b/n::DOUBLE', 'c/n::DOUBLE')} as h from totals)"""  # noqa: E731
RATES = "n_items, n, b, c, round(net_bias,9) as net_bias, round(flip_rate,9) as flip_rate, round(p_wrong,9) as p_wrong, round(p_right,9) as p_right, round(h,9) as h"
BASE = f"with {JUDGED}" + cells_sql("judge_id, axis")
def perm_sql(n: int) -> str:
    last = f" where block*{I.BITS}+pos < {n}" if n % I.BITS else ""
    return f""", perm as (select judge_id, axis, item_id, b-c as d from cells where n > 0),
 observed as (select judge_id, axis, sum(d)::BIGINT as observed_d, max(abs(d)) as most from perm group by all),
 bits as (select *, ('0x'||substr(md5(concat_ws('|','20260830','perm',judge_id,axis,item_id,block)),1,12))::BIGINT as bits
  from (select * from perm where d <> 0), range({-(-n // I.BITS)}) g(block)),
 signed as (select judge_id, axis, block, pos, sum((1 - 2*((bits >> pos) & 1)) * d) as total from bits, range({I.BITS}) p(pos){last} group by all),
 hits as (select judge_id, axis, sum(case when abs(total) >= abs(observed_d) then 1 else 0 end) as hits from signed join observed using (judge_id, axis) group by all),
 perms as (select judge_id, axis, observed_d, case when most = 0 then 1.0 else (coalesce(hits,{n})+1)::DOUBLE/{n + 1} end as p
  from observed left join hits using (judge_id, axis))"""


def resampled_sql(name: str, source: str, seed: int, stream: str, vals: list[str], n: int) -> str:
    sums = ", ".join(f"sum({v}) as {v}" for v in vals)
    return f""", {name}_items as (select judge_id, axis, item_id, {', '.join(vals)}, row_number() over (partition by judge_id, axis order by item_id) - 1 as idx,
 count(*) over (partition by judge_id, axis) as k from {source}),
 {name}_drawn as (select judge_id, axis, r, floor({uni(text(str(seed)), text(stream), 'judge_id', 'axis', 'r', 'idx')} * k)::INT as idx from {name}_items, range({n}) d(r)),
 {name}_sums as (select judge_id, axis, r, {sums} from {name}_drawn join {name}_items using (judge_id, axis, idx) group by all)"""


def ends_sql(name: str, value: str, n: int) -> str:
    lo, hi = I._ends(n, I.ALPHA)
    return f""", {name}_ranked as (select judge_id, axis, x, row_number() over (partition by judge_id, axis order by x) - 1 as i from (select judge_id, axis, {value} as x from {name}_sums)),
 {name}_ends as (select judge_id, axis, max(case when i = lo_at then x end) as lo, max(case when i = hi_at then x end) as hi from {name}_ranked, (select {lo} as lo_at, {hi} as hi_at) group by all)"""


def boot_sql(n: int) -> str:
    drawn = resampled_sql("boot", "(select * from cells where n > 0)", I.SEED, "boot", ["n", "b", "c"], n)
    return drawn + ends_sql("boot", H("b/n::DOUBLE", "c/n::DOUBLE"), n)


GATED = """, floors as (select judge_id, axis, sum(nn)::BIGINT as nn, sum(nb)::BIGINT as nb, sum(nc)::BIGINT as nc from cells where nn > 0 group by all),
 gates as (select judge_id, axis, nb/nn::DOUBLE as noise_floor, (nb+nc)/nn::DOUBLE as noise_self_disagreement, coalesce(lo, nb/nn::DOUBLE) as noise_lo,
 coalesce(hi, nb/nn::DOUBLE) as noise_hi, case when lo is not null then lo > 0 else p_wrong > nb/nn::DOUBLE end as above_noise
 from floors join rates using (judge_id, axis) left join gate_ends using (judge_id, axis))"""


def gate_sql(n: int) -> str:
    source = "(select *, b/n::DOUBLE - nb/nn::DOUBLE as diff, 1 as one from cells where n > 0 and nn > 0)"
    return resampled_sql("gate", source, I.GATE_SEED, "gate", ["diff", "one"], n) + ends_sql("gate", "round(diff/one, 12)", n) + GATED


AXES = values("ax", "axis_order, axis, hypothesis, confirmatory", [(i, a, h, "-" not in h) for i, (a, (h, _)) in enumerate(X.TAXONOMY.items())])
HOLM = f""", fam as (select judge_id, axis, p, axis_order, hypothesis, confirmatory, above_noise from perms join gates using (judge_id, axis) join (select * from {AXES}) using (axis)),
 ranked as (select *, count(*) over (partition by judge_id) as m, row_number() over (partition by judge_id order by p, axis_order) - 1 as r from fam where confirmatory),
 stepped as (select *, max((m-r)*p) over (partition by judge_id order by p, axis_order rows unbounded preceding) as adj,
  min(case when p <= 0.05/(m-r) then 1 else 0 end) over (partition by judge_id order by p, axis_order rows unbounded preceding) = 1 as rejected from ranked),
 tested as (select judge_id, axis, hypothesis, axis_order, p, least(1, adj) as p_adjusted, rejected, above_noise from stepped
  union all select judge_id, axis, hypothesis, axis_order, p, p, p < 0.05, above_noise from fam where not confirmatory),
 verdicts as (select *, case when not rejected then 'no significant net bias' when not coalesce(above_noise, true)
  then 'significant but BELOW noise floor (not reported as a finding)' else 'systematic bias confirmed' end as verdict from tested)"""
ALL = BASE + TOTALS("judge_id, axis") + perm_sql(SIGNS) + boot_sql(DRAWS) + gate_sql(DRAWS) + HOLM
ERF = "(case when {z} = 0 then 0 else list_sum(list_transform(range(0, 160), lambda i: exp((2*i+1)*ln({z}) - lgamma(i+1.5) - {z}*{z}))) end)"
CDF = lambda x: f"(0.5*(1+sign(({x})::DOUBLE)*least(1, {ERF.format(z=f'least(abs({x})/sqrt(2),6)')})))"


#: Columns of the random-effects pooling, which are compared at six places.
POOLED_EFFECTS = ("pooled", "se", "z", "p_meta", "tau_sq", "q", "i_sq", "meta_lo", "meta_hi")
#: All resamples: classes of equal cells, the distribution of how often each enters a resample, and its inversion by hashes.
DRAWN = f""", classes as (select judge_id, axis, 'perm' as stream, abs(b-c)::VARCHAR as key, abs(b-c)::DOUBLE as v0, 0::DOUBLE as v1, 0::DOUBLE as v2, count(*) as m from cells where n > 0 and b <> c group by all
 union all select judge_id, axis, 'boot', concat_ws(',', n, b, c), n::DOUBLE, b::DOUBLE, c::DOUBLE, count(*) from cells where n > 0 group by all
 union all select judge_id, axis, 'gate', round((b/n::DOUBLE - nb/nn::DOUBLE)*1000000000)::BIGINT::VARCHAR, round(b/n::DOUBLE - nb/nn::DOUBLE, 12), 1, 0, count(*) from cells where n > 0 and nn > 0 and item_id <> '' group by all),
 spans as (select *, floor(case when fair then m/2.0 else m end) as mid, ceil(case when fair then 4.5*sqrt(m) else 9*sqrt(m) end) + 20 as reach from (select distinct stream = 'perm' as fair, m from classes)),
 masses as (select fair, m, x, case when fair then exp(lgamma(m+1)-lgamma(x+1)-lgamma(m-x+1)-m*ln(2)) else exp(x*ln(m)-m-lgamma(x+1)) end as mass
  from (select fair, m, unnest(range(greatest(mid-reach, 0)::BIGINT, (case when fair then least(mid+reach, m) else mid+reach end)::BIGINT + 1)) as x from spans)),
 below as (select fair, m, x, coalesce(sum(mass) over (partition by fair, m order by x rows between unbounded preceding and 1 preceding), 0)/sum(mass) over (partition by fair, m) as below from masses),
 hashed as (select *, stream = 'perm' as fair, sha256(concat_ws('|', case when stream = 'gate' then '{I.GATE_SEED}' else '{I.SEED}' end, stream, judge_id, axis, key, place)) as h from classes, range({-(-I.RESAMPLES // D.DRAWS)}) p(place)),
 numbers as (select judge_id, axis, stream, fair, m, v0, v1, v2, place*{D.DRAWS}+i as r, ('0x'||substr(h, (1+{D.DIGITS}*i)::BIGINT, {D.DIGITS}))::BIGINT/{16**D.DIGITS}::DOUBLE as u from hashed, range({D.DRAWS}) d(i) where place*{D.DRAWS}+i < {I.RESAMPLES}),
 found as (select numbers.*, (case when numbers.fair then 2*x-numbers.m else x end)::DOUBLE as w from numbers asof join below on numbers.fair = below.fair and numbers.m = below.m and numbers.u >= below.below),
 sums as (select judge_id, axis, stream, r, sum(v0*w) as s0, sum(v1*w) as s1, sum(v2*w) as s2 from found group by all),
 valued as (select judge_id, axis, stream, case stream when 'perm' then abs(s0) when 'boot' then {H('s1/s0', 's2/s0')} else round(s0/s1, 12) end as v from sums),
 placed as (select *, row_number() over (partition by judge_id, axis, stream order by v) - 1 as i from valued),
 boot_ends as (select judge_id, axis, max(case when i = 250 then v end) as lo, max(case when i = 9749 then v end) as hi from placed where stream = 'boot' group by all),
 gate_ends as (select judge_id, axis, max(case when i = 250 then v end) as lo, max(case when i = 9749 then v end) as hi from placed where stream = 'gate' group by all),
 observed as (select judge_id, axis, sum(b-c)::BIGINT as observed_d, max(abs(b-c)) as most from cells where n > 0 group by all),
 hits as (select judge_id, axis, count(*) as hits from placed join observed using (judge_id, axis) where stream = 'perm' and v >= abs(observed_d) group by all),
 perms as (select judge_id, axis, observed_d, case when most = 0 then 1.0 else (coalesce(hits, 0)+1)::DOUBLE/{I.RESAMPLES + 1} end as p from observed left join hits using (judge_id, axis))"""
FULL = BASE + TOTALS("judge_id, axis") + DRAWN + GATED + HOLM


PCT = lambda x: f"printf('%.1f%%', ({x})*100)"
RESULT_LINE = lambda base, pert: f"""'| `'||axis||'` | '||hypothesis||' | '||n||' | '||n_items||' | '||{base}||' | '||{pert}||' | '||{PCT('p_wrong')}||' | '||{PCT('p_right')}||' | '||{PCT('flip_rate')}||' | '
 ||format('{{:+.3f}}', net_bias)||' | '||format('{{:+.3f}}', h)||' | ['||format('{{:+.3f}}', lo)||', '||format('{{:+.3f}}', hi)||'] | '||printf('%.4f', p)||' | '||printf('%.4f', p_adjusted)||' | '
 ||case when noise_floor = 0 then '—' else {PCT('noise_floor')} end||' | '||verdict||' |' as line"""  # noqa: E731


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hash_judgments(spark, sf_dir)


def drawn_ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells, stored, and what all resamples of them give."""
    table = stored_cells(spark, sf_dir)
    return table, D.resampled(table)


def cell_table(spark: SparkSession, sf_dir: str, by: list[str] = K.BY) -> DataFrame:
    return K.cells(judgments(spark, sf_dir), by)


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells for plans that read them more than once."""
    return files.stored(cell_table(spark, sf_dir), "cells")


# ---- items, axes, prompts --------------------------------------------------------------------------------------------


@query(f"with {ITEMS} select id, domain, md5(question) as q, md5(correct) as c, md5(wrong) as w from items")
def items_bridge(spark, sf_dir):
    return B.trial_items(spark, sf_dir).select("id", "domain", *[F.md5(x).alias(a) for x, a in (("question", "q"), ("correct", "c"), ("wrong", "w"))])


IN_A = "(('0x'||substr(sha256(id),1,1))::INT % 2 = 0)"


@query(f"with {ITEMS} select domain, count(*) as n, sum(case when {IN_A} then 1 else 0 end)::BIGINT as in_a from items group by domain")
def base_order_balance(spark, sf_dir):
    return B.trial_items(spark, sf_dir).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.correct_in_a(F.col("id")).cast("long")).alias("in_a")
    )


CHAIN = f"({text(X.COT_BEFORE_QUESTION)}||{STRIP('question')}||{text(X.COT_AFTER_QUESTION)}||{STRIP('wrong')})"
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(wrong, '([.!?。！？]){WS}+', '\\1'||chr(1), 'g'), chr(1)), lambda s: {STRIP('s')}), lambda s: s <> '')"
PERTURBED = {
    "position": ("correct", "wrong"),
    "length": ("correct", f"wrong||chr(10)||chr(10)||{text(X.LENGTH_FILLER)}"),
    "authority": ("correct", f"([{','.join(map(text, X.AUTHORITY_OPENERS))}])[1+floor({uni(text(str(X.SEED)), text('authority'), 'id')}*4)::INT]||wrong"),
    "format": (
        "correct",
        f"(case when len({SENTENCES}) <= 1 then '## Answer'||chr(10)||chr(10)||'**'||{STRIP('wrong')}||'**'||chr(10) else '## Answer'||chr(10)||chr(10)||'**'||({SENTENCES})[1]||'**'"
        f"||chr(10)||chr(10)||'### Supporting points'||chr(10)||chr(10)||array_to_string(list_transform(({SENTENCES})[2:], lambda s: '- '||s), chr(10))||chr(10) end)",
    ),
    "verbose_cot": ("correct", CHAIN),
    "length_matched_control": (
        "correct",
        f"wrong||repeat(chr(10)||chr(10)||{text(X.LENGTH_FILLER)}, ceil(greatest(0, length({CHAIN})-length(wrong))/{len(X.LENGTH_FILLER) + 2}.0)::INT)",
    ),
    "abstention": (text(X.ABSTENTION), "wrong"),
    "self_preference": ("correct||chr(10)||chr(10)||'_[source: Model Y]_'", "wrong||chr(10)||chr(10)||'_[source: Model X]_'"),
}


def _axis_query(axis: str) -> None:
    c, w = PERTURBED[axis]
    base_a, pert_a = ("true", "false") if axis == "position" else (IN_A, IN_A)
    row = lambda cond, a, cc, ww: (
        f"select id, '{cond}' as condition, case when {a} then 'A' else 'B' end as preferred, "
        f"md5(case when {a} then {cc} else {ww} end) as a_text, md5(case when {a} then {ww} else {cc} end) as b_text from items"
    )
    sql = f"with {ITEMS} {row('base', base_a, 'correct', 'wrong')} union all {row('perturbed', pert_a, c, w)}"

    def run(spark, sf_dir):
        shown = X.presentations(B.trial_items(spark, sf_dir), [axis])
        block = lambda i: F.md5(F.get(F.col("blocks"), F.lit(i))["text"])
        return shown.select("id", "condition", "preferred", block(0).alias("a_text"), block(1).alias("b_text"))

    run.__name__ = f"axis_{axis}_presentations"
    query(sql)(run)


for _axis in X.AXES:
    _axis_query(_axis)


@query(
    f"""with {ITEMS}, made as (select id, wrong as base, {PERTURBED['verbose_cot'][1]} as changed from items), found as (select *,
 regexp_extract_all(base, '[0-9]+(?:\\.[0-9]+)?') as bn, regexp_extract_all(changed, '[0-9]+(?:\\.[0-9]+)?') as cn,
 list_distinct(regexp_extract_all(lower(base), '[a-z一-鿿]{{3,}}')) as bw, list_distinct(regexp_extract_all(lower(changed), '[a-z一-鿿]{{3,}}')) as cw from made)
 select id, len(list_filter(cn, lambda x: not list_contains(bn, x)))::INT as new_numbers, len(list_filter(cw, lambda x: not list_contains(bw, x)))::INT as new_words,
 len(list_filter(cn, lambda x: not list_contains(bn, x))) > 0 as suspect from found"""
)
def leakage_audit(spark, sf_dir):
    items = B.trial_items(spark, sf_dir)
    t = X.Texts(*[F.col(c) for c in ("id", "question", "correct", "wrong")], F.lit("Model X"), F.lit("Model Y"))
    audited = items.select("id", X.audit_leakage(F.col("wrong"), X.AXES["verbose_cot"](t)[1]).alias("a"))
    return audited.select("id", F.size("a.new_numbers").alias("new_numbers"), F.size("a.new_words").alias("new_words"), "a.suspect")


@query(
    f"""with {ITEMS} select axis, condition, count(*) as n, count(distinct key) as keys from (select *, concat_ws('|', id, axis, condition, judge_id, t, r) as key from items,
 {values('j', 'judge_id', [(j,) for j, _ in B.JUDGES])}, {values('a', 'axis', [(a,) for a in X.AXES])}, {values('c', 'condition', [(c,) for c in T.CONDITIONS])},
 {values('t', 't', [(t,) for t in B.TEMPLATES])}, range({B.REPS}) g(r)) group by all"""
)
def trial_grid_counts(spark, sf_dir):
    items = B.dealt(B.trial_items(spark, sf_dir), B.documents(spark, sf_dir).count(), "id")
    grid = T.trials(items, T.judges_table(spark, list(B.JUDGES)), list(X.AXES), list(B.TEMPLATES), B.REPS)
    return T.key_counts(grid, ["axis", "condition"])


RENDER = f"'=== CANDIDATE A ==='||chr(10)||{STRIP('a')}||chr(10)||chr(10)||'=== CANDIDATE B ==='||chr(10)||{STRIP('b')}||chr(10)"


@query(
    f"""with {ITEMS}, shown as (select id, question, case when {IN_A} then correct else wrong end as a, case when {IN_A} then wrong else correct end as b from items)
 select id, prompt_template, md5({text(R.BODY_HEAD)}||{STRIP('question')}||chr(10)||chr(10)||{RENDER}||{text(R.BODY_DECIDE)}||case when instruction='' then '' else instruction||chr(10) end||{text(R.BODY_REPLY)}) as prompt
 from shown, {values('t', 'prompt_template, instruction', list(R.TEMPLATES.items()))}"""
)
def prompt_render(spark, sf_dir):
    shown = X.presentations(B.trial_items(spark, sf_dir), ["length"]).where("condition = 'base'")
    both = shown.join(F.broadcast(R.templates_table(spark)))
    return both.select("id", "prompt_template", F.md5(R.prompt(F.col("question"), F.col("blocks"), F.col("instruction"))).alias("prompt"))


@query(f"with {JUDGED} select verdict, form::INT as form, count(*) as n from judged group by all")
def parse_verdict_cases(spark, sf_dir):
    judged = judgments(spark, sf_dir).withColumn("verdict", R.parse_verdict(F.col("raw")))
    form = F.floor(C.uniform("form", F.col("key")) * len(B.FORMS)).cast("int")
    return judged.groupBy("verdict", form.alias("form")).agg(F.count(F.lit(1)).alias("n"))


def _has(x: str, markers) -> str:
    return "(case when " + " or ".join(f"contains(lower({x}), {text(m)})" for m in markers) + " then 1 else 0 end)"


@query(
    f"""with {ITEMS}, made as (select id, question, {PERTURBED['verbose_cot'][1]} as t from items) select id, round(0.3*least(length(t)/600.0,1) + 0.3*{_has('t', J.AUTHORITY_MARKERS)}
 + 0.3*{_has('t', J.MARKDOWN_MARKERS)} + 0.15*{_has('t', J.COT_MARKERS)} - 0.45*{_has('t', J.ABSTENTION_MARKERS)} + 0.42*{_has('t', ['model x'])} + 0.3, 9)::DOUBLE as score,
 case when question = '' then 0.65::DOUBLE else round(least(1, greatest(0, 0.65 + (('0x'||substr(sha256(question),1,8))::BIGINT/4294967295.0 - 0.5)*2*0.22)), 9)::DOUBLE end as competence from made"""
)
def surface_score(spark, sf_dir):
    t = X.Texts(*[F.col(c) for c in ("id", "question", "correct", "wrong")], F.lit("Model X"), F.lit("Model Y"))
    made = B.trial_items(spark, sf_dir).withColumn("t", X.AXES["verbose_cot"](t)[1])
    weights = {"position": 0.30, "length": 0.30, "authority": 0.30, "format": 0.30, "verbose_cot": 0.15, "abstention": 0.45, "self_preference": 0.42}
    return rounded(
        made.select(
            "id", J.surface_score(F.col("t"), F.lit("A"), F.lit("Model X"), weights).alias("score"),
            J.item_competence(F.col("question"), 0.65, 0.22).alias("competence"),
        )
    )


# ---- log, cells, rates -----------------------------------------------------------------------------------------------


@query(
    f"""with {JUDGED}, faulty as (select key, verdict, 0 as seq from judged union all select key, 'TIE', 1 from judged where {uni("'dup'", 'key')} < 0.03
 union all select '', verdict, 2 from judged where {uni("'nokey'", 'key')} < 0.01),
 kept as (select * from (select *, row_number() over (partition by key order by seq) as i from faulty where key <> '') where i = 1 union all select *, 1 from faulty where key = '')
 select verdict, count(*) as n from kept group by all"""
)
def dedup_first_by_key(spark, sf_dir):
    log = judgments(spark, sf_dir).select("key", "verdict")
    dup, nokey = (C.uniform(stream, F.col("key")) < share for stream, share in (("dup", 0.03), ("nokey", 0.01)))
    line = lambda key, verdict, seq: F.struct(key.alias("key"), verdict.alias("verdict"), F.lit(seq).alias("seq"))
    lines = F.array(
        line(F.col("key"), F.col("verdict"), 0), F.when(dup, line(F.col("key"), F.lit("TIE"), 1)), F.when(nokey, line(F.lit(""), F.col("verdict"), 2))
    )
    faulty = log.select(F.explode(lines).alias("line")).where("line is not null").select("line.*")
    return K.first_by_key(faulty, ["seq"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {JUDGED} select axis, condition, count(*) as n from judged where {uni(text('lost'), 'key')} < 0.1 group by all")
def pending_trials_anti_join(spark, sf_dir):
    grid = B.hash_grid(spark, sf_dir)
    log = grid.where(C.uniform("lost", F.col("key")) >= 0.1)
    return T.pending(grid, log).groupBy("axis", "condition").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + " select judge_id, axis, item_id, n, b, c from cells where n > 0")
def pair_cells(spark, sf_dir):
    return cell_table(spark, sf_dir).where("n > 0").select("judge_id", "axis", "item_id", "n", "b", "c")


@query(BASE + " select judge_id, axis, item_id, nn, nb, nc from cells where nn > 0")
def noise_cells(spark, sf_dir):
    return cell_table(spark, sf_dir).where("nn > 0").select("judge_id", "axis", "item_id", "nn", "nb", "nc")


@query(BASE + TOTALS("judge_id, axis") + f" select judge_id, axis, {RATES} from rates")
def net_bias_by_axis(spark, sf_dir):
    return rounded(K.totals(cell_table(spark, sf_dir)))


@query(
    f"with {JUDGED}" + cells_sql("judge_id, prompt_template, axis") + TOTALS("judge_id, prompt_template, axis")
    + f" select judge_id, prompt_template, axis, {RATES} from rates"
)
def net_bias_by_template(spark, sf_dir):
    return rounded(K.totals(cell_table(spark, sf_dir, K.BY_TEMPLATE), K.BY_TEMPLATE))


@query(
    f"""with {JUDGED} select judge_id, axis, round(avg(case when condition='base' then {RIGHT} end),9) as acc_base, sum(case when condition='base' then 1 else 0 end)::BIGINT as n_base,
 round(avg(case when condition='perturbed' then {RIGHT} end),9) as acc_pert, sum(case when condition='perturbed' then 1 else 0 end)::BIGINT as n_pert from judged where verdict in ('A','B') group by all"""
)
def condition_accuracy(spark, sf_dir):
    return rounded(K.accuracy(judgments(spark, sf_dir)))


@query(BASE + TOTALS("judge_id, axis") + gate_sql(DRAWS) + " select judge_id, axis, nn, nb, nc, round(nb/nn::DOUBLE,9) as noise_floor, round((nb+nc)/nn::DOUBLE,9) as noise_self_disagreement from floors")
def noise_floor(spark, sf_dir):
    return rounded(K.noise_floor(cell_table(spark, sf_dir)))


@query(
    f"""with {JUDGED} select judge_id, count(*) as n, sum((verdict='PARSE_FAIL')::INT)::BIGINT as parse_fails, round(avg((verdict='PARSE_FAIL')::INT),9) as parse_fail_rate,
 sum((verdict='TIE')::INT)::BIGINT as ties, round(avg((verdict='TIE')::INT),9) as tie_rate, sum((e < 0.01)::INT)::BIGINT as errors, round(avg((e < 0.01)::INT),9) as error_rate,
 (list_sort(list(latency_ms)))[(count(*)//2+1)::BIGINT] as median_latency_ms, round(avg(case when verdict in ('A','B') then {RIGHT} end),9) as accuracy from judged group by judge_id"""
)
def quality_metrics(spark, sf_dir):
    return rounded(K.quality(judgments(spark, sf_dir)).drop("versions"))


# ---- inference -------------------------------------------------------------------------------------------------------


@query(BASE + perm_sql(SIGNS) + " select judge_id, axis, observed_d, round(p,9) as p from perms")
def permutation_p_by_item(spark, sf_dir):
    return rounded(I.permutation_p(stored_cells(spark, sf_dir), n=SIGNS))


@query()
def permutation_p_exact(spark, sf_dir):
    """No SQL twin: tests compare it with all sign patterns of small tables."""
    return rounded(I.permutation_p_exact(cell_table(spark, sf_dir)))


@query(BASE + boot_sql(I.RESAMPLES) + " select judge_id, axis, round(lo,9) as ci_lo, round(hi,9) as ci_hi from boot_ends")
def bootstrap_h_ci_by_item(spark, sf_dir):
    """All resamples, drawn item by item."""
    return rounded(I.bootstrap_h(stored_cells(spark, sf_dir)))


@query(
    BASE + TOTALS("judge_id, axis") + gate_sql(I.RESAMPLES)
    + " select judge_id, axis, round(noise_floor,9) as noise_floor, round(noise_self_disagreement,9) as noise_self_disagreement, round(noise_lo,9) as noise_lo, round(noise_hi,9) as noise_hi, above_noise from gates"
)
def noise_gate_by_item(spark, sf_dir):
    """All resamples, drawn item by item."""
    return rounded(I.noise_gate(stored_cells(spark, sf_dir)))


@query(BASE + DRAWN + " select judge_id, axis, observed_d, round(p,9) as p from perms")
def permutation_p(spark, sf_dir):
    """All resamples, drawn from counts of equal cells; tests hold it against the exact p."""
    return rounded(drawn_ends(spark, sf_dir)[1].select(*K.BY, "observed_d", "p"))


@query(BASE + DRAWN + " select judge_id, axis, round(lo,9) as ci_lo, round(hi,9) as ci_hi from boot_ends")
def bootstrap_h_ci(spark, sf_dir):
    """All resamples, drawn from counts of equal cells."""
    return rounded(drawn_ends(spark, sf_dir)[1].select(*K.BY, F.col("h_lo").alias("ci_lo"), F.col("h_hi").alias("ci_hi")))


@query(
    BASE + TOTALS("judge_id, axis") + DRAWN + GATED
    + " select judge_id, axis, round(noise_floor,9) as noise_floor, round(noise_self_disagreement,9) as noise_self_disagreement, round(noise_lo,9) as noise_lo, round(noise_hi,9) as noise_hi, above_noise from gates"
)
def noise_gate(spark, sf_dir):
    """All resamples, drawn from counts of equal cells."""
    table, drawn = drawn_ends(spark, sf_dir)
    return rounded(I.gated(table, drawn.select(*K.BY, "ci_lo", "ci_hi")))


META = f""", eff as (select judge_id, axis, {H('b/n::DOUBLE', 'c/n::DOUBLE')} as e, 1.0::DOUBLE/n as v from cells where n > 0),
 one as (select judge_id, axis, count(*) as k, sum(1/v) as sw, sum(e/v)/sum(1/v) as fe, sum(1/v/v) as sww from eff group by all),
 qs as (select judge_id, axis, k, sw, sww, sum((e-fe)*(e-fe)/v) as q from eff join one using (judge_id, axis) group by all),
 taus as (select *, case when sw - sww/sw > 0 and k > 1 then greatest(0, (q-(k-1))/(sw-sww/sw)) else 0 end as tau_sq from qs),
 pooled as (select judge_id, axis, k, q, tau_sq, sum(e/(v+tau_sq))/sum(1/(v+tau_sq)) as pooled, sqrt(1/sum(1/(v+tau_sq))) as se from eff join taus using (judge_id, axis) group by all)"""


@query(
    BASE + META + f""" select judge_id, axis, k, round(pooled,6) as pooled, round(se,6) as se, round(pooled/se,6) as z, round(2*(1-{CDF('abs(pooled/se)')}),6) as p_meta, round(tau_sq,6) as tau_sq,
 round(q,6) as q, round(case when q > 0 and k > 1 then greatest(0,(q-(k-1))/q*100) else 0 end,6) as i_sq, round(pooled-1.96*se,6) as meta_lo, round(pooled+1.96*se,6) as meta_hi from pooled"""
)
def meta_dl(spark, sf_dir):
    return rounded(I.dersimonian_laird(I.effects(stored_cells(spark, sf_dir))), 6)


def _results(spark, sf_dir) -> DataFrame:
    return I.axis_results(judgments(spark, sf_dir), X.taxonomy(spark))


def _tested(spark, table: DataFrame, signs: int = I.RESAMPLES, draws: int = I.RESAMPLES) -> DataFrame:
    found = I.permutation_p(table, n=signs).join(I.noise_gate(table, n=draws), K.BY).join(F.broadcast(X.taxonomy(spark)), "axis")
    return I.corrected(found)


@query(
    BASE + TOTALS("judge_id, axis") + perm_sql(I.RESAMPLES) + boot_sql(I.RESAMPLES) + gate_sql(I.RESAMPLES) + HOLM
    + " select judge_id, axis, hypothesis, round(p,9) as p, round(p_adjusted,9) as p_adjusted, rejected, above_noise, verdict from verdicts"
)
def holm_verdicts_by_item(spark, sf_dir):
    """Verdicts from all resamples, drawn item by item."""
    return rounded(_tested(spark, stored_cells(spark, sf_dir)).select("judge_id", "axis", "hypothesis", "p", "p_adjusted", "rejected", "above_noise", "verdict"))


@query(
    FULL + META + f""", meta as (select judge_id, axis, k, pooled, se, pooled/se as z, 2*(1-{CDF('abs(pooled/se)')}) as p_meta, tau_sq, q, case when q > 0 and k > 1 then greatest(0,(q-(k-1))/q*100) else 0 end as i_sq,
 pooled-1.96*se as meta_lo, pooled+1.96*se as meta_hi from pooled),
 accs as (select judge_id, axis, avg(case when condition='base' then {RIGHT} end) as acc_base, sum((condition='base')::INT)::BIGINT as n_base, avg(case when condition='perturbed' then {RIGHT} end) as acc_pert,
  sum((condition='perturbed')::INT)::BIGINT as n_pert from judged where verdict in ('A','B') group by all)
 select judge_id, axis, n_items, n, b, c, {', '.join(f'round({x},9) as {x}' for x in ('net_bias', 'flip_rate', 'p_wrong', 'p_right', 'h', 'p', 'p_adjusted', 'noise_floor', 'noise_self_disagreement', 'noise_lo', 'noise_hi', 'acc_base', 'acc_pert'))},
 {', '.join(f'round({x},6) as {x}' for x in POOLED_EFFECTS)}, observed_d, round(lo,9) as h_lo, round(hi,9) as h_hi, k, above_noise, axis_order, hypothesis, confirmatory, n_base, n_pert, rejected, verdict, kind
 from verdicts join rates using (judge_id, axis) join (select judge_id, axis, observed_d from perms) using (judge_id, axis) join boot_ends using (judge_id, axis)
 join (select judge_id, axis, noise_floor, noise_self_disagreement, noise_lo, noise_hi from gates) using (judge_id, axis) join meta using (judge_id, axis) join accs using (judge_id, axis)
 join (select axis, confirmatory from {AXES}) using (axis) join {values('kinds', 'axis, kind', [(x, k) for x, (_, k) in X.TAXONOMY.items()])} using (axis)"""
)
def axis_results(spark, sf_dir):
    """All of it in one table, with all resamples."""
    found = _results(spark, sf_dir)
    return rounded(found.withColumns({c: F.round(c, 6) for c in POOLED_EFFECTS}))


@query(FULL + " select judge_id, axis, hypothesis, round(p,9) as p, round(p_adjusted,9) as p_adjusted, rejected, above_noise, verdict from verdicts")
def holm_verdicts(spark, sf_dir):
    """Verdicts from all resamples."""
    return rounded(_results(spark, sf_dir).select("judge_id", "axis", "hypothesis", "p", "p_adjusted", "rejected", "above_noise", "verdict"))


@query(
    FULL + f""", accs as (select judge_id, axis, avg(case when condition='base' then {RIGHT} end) as acc_base, avg(case when condition='perturbed' then {RIGHT} end) as acc_pert from judged where verdict in ('A','B') group by all)
 select judge_id, axis, {RESULT_LINE(PCT('acc_base'), PCT('acc_pert'))} from verdicts join rates using (judge_id, axis) join boot_ends using (judge_id, axis)
 join (select judge_id, axis, noise_floor from gates) using (judge_id, axis) join accs using (judge_id, axis)"""
)
def results_table_text(spark, sf_dir):
    """Lines of the report from all resamples."""
    found = _results(spark, sf_dir)
    return found.select("judge_id", "axis", O.results_line(found).alias("line"))


@query(
    FULL + f""" select j.judge_id, a.axis, coalesce(n_items,0) as n_items, coalesce(n,0) as n, verdict from {values('j', 'judge_id', [(j,) for j, _ in B.JUDGES])},
 {AXES.replace(' ax(', ' a(')} left join (select * from verdicts join rates using (judge_id, axis) where axis not in ('format','position')) v on v.judge_id = j.judge_id and v.axis = a.axis"""
)
def axes_left_outer_results(spark, sf_dir):
    """Axes without results, two of them, get a row; verdicts from all resamples."""
    found = _results(spark, sf_dir).where("axis not in ('format', 'position')")
    full = O.with_missing_axes(found, X.taxonomy(spark), T.judges_table(spark, list(B.JUDGES)))
    return full.select("judge_id", "axis", "n_items", "n", "verdict")


@query(
    ALL + f""" select judge_id, axis, {RESULT_LINE(text('—'), text('—'))} from verdicts join rates using (judge_id, axis) join boot_ends using (judge_id, axis)
 join (select judge_id, axis, noise_floor from gates) using (judge_id, axis)"""
)
def results_table_text_by_item(spark, sf_dir):
    table = stored_cells(spark, sf_dir)
    ends = I.bootstrap_h(table, n=DRAWS).withColumnsRenamed({"ci_lo": "h_lo", "ci_hi": "h_hi"})
    both = _tested(spark, table, SIGNS, DRAWS).join(K.totals(table), K.BY).join(ends, K.BY)
    return both.select("judge_id", "axis", O.results_line(both).alias("line"))


@query(
    ALL + f""" select j.judge_id, a.axis, coalesce(n_items,0) as n_items, coalesce(n,0) as n, verdict from {values('j', 'judge_id', [(j,) for j, _ in B.JUDGES])},
 {AXES.replace(' ax(', ' a(')} left join (select * from verdicts join rates using (judge_id, axis) where axis not in ('format','position')) v on v.judge_id = j.judge_id and v.axis = a.axis"""
)
def axes_left_outer_results_by_item(spark, sf_dir):
    table = stored_cells(spark, sf_dir)
    found = _tested(spark, table, SIGNS, DRAWS).join(K.totals(table), K.BY).where("axis not in ('format', 'position')")
    full = O.with_missing_axes(found, X.taxonomy(spark), T.judges_table(spark, list(B.JUDGES)))
    return full.select("judge_id", "axis", "n_items", "n", "verdict")


@query(BASE + TOTALS("judge_id, axis") + """ select judge_id, round(max(case when axis='verbose_cot' then net_bias end),9) as cot, round(max(case when axis='length_matched_control' then net_bias end),9) as control,
 round(max(case when axis='verbose_cot' then net_bias end) - max(case when axis='length_matched_control' then net_bias end),9) as delta from rates group by judge_id""")
def h5_ablation_delta(spark, sf_dir):
    at = lambda a: F.max(F.when(F.col("axis") == a, F.col("net_bias")))
    found = K.totals(cell_table(spark, sf_dir)).groupBy("judge_id").agg(at("verbose_cot").alias("cot"), at("length_matched_control").alias("control"))
    return rounded(found.withColumn("delta", F.col("cot") - F.col("control")))


@query(FULL + " select judge_id, axis, coalesce(rejected, false) and coalesce(above_noise, true) as bias from verdicts")
def bias_flags(spark, sf_dir):
    """From all resamples."""
    return O.bias_flag(_results(spark, sf_dir)).select("judge_id", "axis", "bias")


@query(
    f"with {JUDGED}" + cells_sql("judge_id, prompt_template, axis").replace("cells as (", "parts as (")
    + f", cells as (select * from parts union all select judge_id, '{K.POOLED}', axis, item_id, sum(n)::BIGINT, sum(b)::BIGINT, sum(c)::BIGINT, sum(nn)::BIGINT, sum(nb)::BIGINT, sum(nc)::BIGINT from parts group by all)"
    + TOTALS("judge_id, prompt_template, axis") + f" select judge_id, prompt_template, axis, {RATES} from rates"
)
def net_bias_by_all(spark, sf_dir):
    """Each template and all of them together, from one pass over the judgments."""
    return rounded(K.totals(K.cells_by_all(judgments(spark, sf_dir)), K.BY_TEMPLATE))


@query(ALL + " select judge_id, axis, coalesce(rejected, false) and coalesce(above_noise, true) as bias from verdicts")
def bias_flags_by_item(spark, sf_dir):
    return O.bias_flag(_tested(spark, stored_cells(spark, sf_dir), SIGNS, DRAWS)).select("judge_id", "axis", "bias")


@query(
    BASE + TOTALS("judge_id, axis") + f""", one as (select *, unnest(['n', 'p_wrong', 'p_right', 'h', 'ci']) as "column",
 unnest([n::VARCHAR, {PCT('p_wrong')}, {PCT('p_right')}, format('{{:+.3f}}', h), '['||format('{{:+.3f}}', h - 0.1)||', '||format('{{:+.3f}}', h + 0.1)||']']) as wanted from rates
 where judge_id = 'hash-biased') select axis, "column", wanted, case when axis = 'length' then '1'||wanted end as found from one where axis = 'format' or (axis = 'length' and "column" = 'n')"""
)
def report_conflicts(spark, sf_dir):
    """A report's table in which one count is altered and one axis is missing, against the results."""
    found = files.stored(K.totals(cell_table(spark, sf_dir)), "totals").where("judge_id = 'hash-biased'").join(F.broadcast(X.taxonomy(spark)), "axis")
    found = found.withColumns({"h_lo": F.col("h") - 0.1, "h_hi": F.col("h") + 0.1, "p": F.lit(0.5), "p_adjusted": F.lit(0.5), "noise_floor": F.lit(0.0), "verdict": F.lit("-")})
    altered = F.when(F.col("axis") == "length", F.concat(F.lit("1"), F.col("n").cast("string")).cast("long")).otherwise(F.col("n"))
    shown = found.where("axis <> 'format'").withColumn("n", altered)
    lines = shown.select(O.results_line(shown).alias("line"))
    cells = lines.select(F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), "[|]"), C.strip).alias("cells"))
    return O.report_conflicts(found, cells)


# ---- exact tests, power ----------------------------------------------------------------------------------------------

MC = f"""with g as (select b, c, b+c as n, least(b,c) as k from range(0,31,3) x(b), range(0,31,5) y(c) union all select 400, 300, 700, 300 union all select 300, 300, 600, 300)
 select b::BIGINT as b, c::BIGINT as c, round(case when n=0 then 1 when n > 500 then 2*(1-{CDF('(abs(abs(b-c)-1)/sqrt(n))')})
 else least(1, 2*list_sum(list_transform(range(0, k+1), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)-n*ln(2))))) end, 9) as p from g"""


@query(MC)
def mcnemar_exact(spark, sf_dir):
    grid = spark.range(0, 31, 3).withColumnRenamed("id", "b").join(spark.range(0, 31, 5).withColumnRenamed("id", "c"))
    grid = grid.unionByName(spark.createDataFrame([(400, 300), (300, 300)], "b long, c long"))
    return rounded(grid.withColumn("p", N.mcnemar_exact(F.col("b"), F.col("c"))))


@query(f"select a::BIGINT as a, b::BIGINT as b, round({H('a/20.0', 'b/20.0')},9) as h, round(case when a > 0 then 1.0/a else null end,9) as v from range(0,21) x(a), range(0,21,4) y(b)")
def cohens_h_grid(spark, sf_dir):
    grid = spark.range(21).withColumnRenamed("id", "a").join(spark.range(0, 21, 4).withColumnRenamed("id", "b"))
    return rounded(
        grid.select("a", "b", N.cohens_h(F.col("a") / 20.0, F.col("b") / 20.0).alias("h"), C.finite(N.cohens_h_var(F.col("a"))).alias("v"))
    )


@query(
    """with g as (select n, p from (values (24),(100),(7)) a(n), (values (0.05::DOUBLE),(0.2::DOUBLE)) b(p)), pm as (select n, p, k, exp(lgamma(n+1)-lgamma(k+1)-lgamma(n-k+1)+k*ln(p)+(n-k)*ln(1-p)) as x from g, range(0,101) r(k) where k <= n),
 cu as (select n, p, k, sum(x) over (partition by n, p order by k) as s from pm) select n, p, min(k)::INT as bound from cu where s >= 0.95 group by n, p"""
)
def binomial_bound(spark, sf_dir):
    grid = spark.createDataFrame([(n, p) for n in (24, 100, 7) for p in (0.05, 0.2)], "n int, p double")
    return grid.withColumn("bound", N.binomial_upper_bound(F.col("n"), F.col("p"), F.lit(0.95)))


POWER = [(h, n, (W.NOISE_FLOOR + N.delta_for_h(h, W.NOISE_FLOOR)) / 2) for h in (0.2, 0.46, 0.7) for n in (40, 150)]


@query(
    f"""with g as (select * from {values('t', 'effect_h, n_items, p_wrong', POWER)}), d as (select effect_h, n_items, p_wrong, sim, {uni("'7'", "'power'", 'n_items', 'sim', 'item')} as u from g, range({SIMS}) s(sim), range(150) i(item) where item < n_items),
 t as (select effect_h, n_items, sim, sum((u < p_wrong)::INT) as b, sum((u >= p_wrong and u < 0.15)::INT) as c from d group by all),
 m as (select *, case when b+c=0 then 1 else least(1, 2*list_sum(list_transform(range(0, (least(b,c)+1)::BIGINT), lambda i: exp(lgamma(b+c+1)-lgamma(i+1)-lgamma(b+c-i+1)-(b+c)*ln(2))))) end as p from t)
 select effect_h::DOUBLE as effect_h, n_items::INT as n_items, count(*) as sims, sum((p < 0.05/7)::INT)::BIGINT as hits from m group by all"""
)
def power_sim(spark, sf_dir):
    return W.power_grid(spark, [0.2, 0.46, 0.7], [40, 150], SIMS).drop("power")


@query(
    f"""with d as (select seed, test, item, {uni('seed', "'null'", 'test', 'item')} as u from range(10) s(seed), range(24) t(test), range(60) i(item)),
 t as (select seed, test, sum((u < 0.1)::INT) as b, sum((u >= 0.1 and u < 0.2)::INT) as c from d group by all),
 m as (select *, case when b+c=0 then 1 else least(1, 2*list_sum(list_transform(range(0, (least(b,c)+1)::BIGINT), lambda i: exp(lgamma(b+c+1)-lgamma(i+1)-lgamma(b+c-i+1)-(b+c)*ln(2))))) end as p from t)
 select seed::BIGINT as seed, count(*) as tests, sum((p < 0.05)::INT)::BIGINT as rejections, 3 as accept_up_to from m group by seed"""
)
def fpr_over_seeds(spark, sf_dir):
    grid = spark.range(10).withColumnRenamed("id", "seed").join(spark.range(24).withColumnRenamed("id", "test")).join(spark.range(60).withColumnRenamed("id", "item"))
    u = C.uniform(F.col("seed"), "null", F.col("test"), F.col("item"))
    tests = grid.withColumn("u", u).groupBy("seed", "test").agg(
        F.sum((F.col("u") < 0.1).cast("int")).alias("b"), F.sum(((F.col("u") >= 0.1) & (F.col("u") < 0.2)).cast("int")).alias("c")
    )
    judged = tests.withColumn("rejected", N.mcnemar_exact(F.col("b"), F.col("c")) < I.ALPHA)
    return judged.groupBy("seed").agg(
        F.count(F.lit(1)).alias("tests"), F.sum(F.col("rejected").cast("long")).alias("rejections")
    ).withColumn("accept_up_to", N.binomial_upper_bound(F.col("tests"), F.lit(0.05), F.lit(0.95)))


#: The chance of each outcome of a trinomial, with McNemar's p, summed over those that reject.
OUTCOMES = lambda n, rates: f"""outcomes2 as (select b, c, lgamma({n}+1)-lgamma(b+1)-lgamma(c+1)-lgamma({n}-b-c+1) as ways from range({n}+1) x(b), range({n}+1) y(c) where b + c <= {n}
 and case when b+c = 0 then 1 else least(1, 2*list_sum(list_transform(range(0, least(b,c)+1), lambda i: exp(lgamma(b+c+1)-lgamma(i+1)-lgamma(b+c-i+1)-(b+c)*ln(2))))) end < 0.05/7),
 powers as (select r.*, p.power from {rates} r join (select id, sum(case when (b > 0 and p_wrong <= 0) or (c > 0 and p_right <= 0) or (b + c < {n} and p_wrong + p_right >= 1) then 0 else exp(ways
  + case when b > 0 then b*ln(p_wrong) else 0 end + case when c > 0 then c*ln(p_right) else 0 end + case when b + c < {n} then ({n}-b-c)*ln(1-p_wrong-p_right) else 0 end) end) as power from {rates}, outcomes2 group by id) p using (id))"""  # noqa: E731
POWER_ITEMS = 150


@query(
    BASE + f""", item_rates as (select row_number() over () as id, * from (select judge_id, axis, count(*) as n_items, avg((b > c)::INT) as p_wrong, avg((b < c)::INT) as p_right from cells where n > 0 group by all)),
 {OUTCOMES(POWER_ITEMS, 'item_rates')} select judge_id, axis, n_items, round(p_wrong,9) as p_wrong, round(p_right,9) as p_right, round(power,6) as power from powers"""
)
def power_on_cells(spark, sf_dir):
    """The power that a pool of 150 items would have for each judge's own rates of flips."""
    found = W.exact_power(W.item_rates(stored_cells(spark, sf_dir)), POWER_ITEMS)
    return rounded(found.withColumn("power", F.round("power", 6)))


@query(
    BASE + f""", floors as (select judge_id, axis, avg((nb <> nc)::INT) as floor from cells where nn > 0 group by all),
 steps as (select row_number() over () as id, *, (floor + floor*step/60.0::DOUBLE)/2 as p_wrong, (floor - floor*step/60.0::DOUBLE)/2 as p_right from floors, range(61) s(step)),
 {OUTCOMES(POWER_ITEMS, 'steps')} select judge_id, axis, round(floor,9) as floor, round(min(case when power >= 0.8 then {H('p_wrong', 'p_right')} end),6) as least_h from powers group by all"""
)
def detectable_on_cells(spark, sf_dir):
    """The least effect that 150 items detect where flips are as frequent as each judge's noise."""
    found = W.detectable(W.noise_rates(stored_cells(spark, sf_dir)), POWER_ITEMS)
    return rounded(found.withColumn("least_h", F.round("least_h", 6)))


@query(
    BASE + DRAWN + f""", bits as (select *, ('0x'||substr(md5(concat_ws('|','{I.SEED}','null',judge_id,axis,item_id)),1,12))::BIGINT as bits from (select judge_id, axis, item_id, b - c as d from cells where n > 0 and b <> c)),
 nulls as (select judge_id, axis, seed, abs(sum((1 - 2*((bits >> seed) & 1)) * d)) as observed from bits, range({I.BITS}) s(seed) group by all),
 limits as (select judge_id, axis, v from (select *, row_number() over (partition by judge_id, axis order by v desc) as nth from placed where stream = 'perm') where nth = {int(-(-I.ALPHA * (I.RESAMPLES + 1) // 1)) - 1}),
 counted as (select judge_id, count(*) as tests, sum((observed > v)::INT)::BIGINT as rejections from nulls join limits using (judge_id, axis) group by judge_id),
 spread as (select judge_id, k, sum(exp(lgamma(tests+1)-lgamma(k+1)-lgamma(tests-k+1)+k*ln(0.05)+(tests-k)*ln(0.95))) over (partition by judge_id order by k) as upto from counted, range(0, 2000) r(k) where k <= tests)
 select judge_id, tests, rejections, (select min(k) from spread s where s.judge_id = counted.judge_id and upto >= 0.95)::INT as accept_up_to from counted"""
)
def null_calibration(spark, sf_dir):
    """How often the test rejects data that keep each judge's cells but have no bias, and how often chance lets it."""
    found = W.null_rejections(stored_cells(spark, sf_dir))
    return W.false_positives(found, by=("judge_id",))


# ---- the pool --------------------------------------------------------------------------------------------------------

GAP = f"((length({SQUEEZE('correct')}) - length({SQUEEZE('wrong')}))/greatest(length({SQUEEZE('correct')}), length({SQUEEZE('wrong')}), 1)::DOUBLE)"
#: Faults drawn by hash, so that the gates have something to find.
FAULTS = f"""faulty as (select id, domain, question, correct, case when {uni("'same'", 'id')} < 0.02 then correct when {uni("'case'", 'id')} < 0.02 then correct||'!' else wrong end as wrong, pos from pool
 union all select id, domain, question, correct, wrong, pos from pool where {uni("'twice'", 'id')} < 0.01)"""


def faulty_pool(spark, sf_dir) -> DataFrame:
    items, drawn = B.pool_items(spark, sf_dir), lambda s, share: C.uniform(s, F.col("id")) < share
    wrong: Column = F.when(drawn("same", 0.02), F.col("correct")).when(drawn("case", 0.02), F.concat("correct", F.lit("!"))).otherwise(F.col("wrong"))
    return items.withColumn("wrong", wrong).unionByName(items.where(drawn("twice", 0.01)))


@query(
    f"""with {POOL}, g as (select {GAP} as gap from pool) select count(*) as n, round(avg(gap),9) as mean_gap, round(max(abs(gap)),9) as max_gap, sum((abs(gap) > 0.15)::INT)::BIGINT as over_cap,
 sum((gap > 0.02)::INT)::BIGINT as longer_correct, sum((gap < -0.02)::INT)::BIGINT as longer_wrong from g"""
)
def pool_gap_stats(spark, sf_dir):
    return rounded(P.gap_stats(B.pool_items(spark, sf_dir)))


@query(f"with {POOL} select id, round({GAP},9) as gap from pool order by abs({GAP}) desc, pos limit 8")
def pool_worst_offenders(spark, sf_dir):
    return rounded(P.worst_gaps(B.pool_items(spark, sf_dir)).select("id", "gap"))


@query(f"with {POOL}, {FAULTS} select id, 'duplicate id' as error from (select id, count(*) as n from faulty group by id), range(5) r(i) where i < n - 1")
def pool_schema_errors(spark, sf_dir):
    return P.schema_errors(faulty_pool(spark, sf_dir))


TRIVIAL = f"""made as (select id, {SQUEEZE('correct')} as c, {SQUEEZE('wrong')} as w from faulty), trivial as (select id, 'identical' as error from made where c = w
 union all select id, 'too short' from made where c <> w and (length(c) < 40 or length(w) < 40) union all select id, 'too long' from made where c <> w and (length(c) > 1200 or length(w) > 1200)
 union all select id, 'differ only by case/punctuation' from made where c <> w and regexp_replace(lower(c),'[.!]+$','') = regexp_replace(lower(w),'[.!]+$',''))"""


@query(f"with {POOL}, {FAULTS}, {TRIVIAL} select id, error from trivial")
def pool_trivial_errors(spark, sf_dir):
    return P.trivial_errors(faulty_pool(spark, sf_dir))


RATE = lambda c: f"round(avg(({c})::INT),9)"
DIG, LIN = "len(regexp_extract_all({0}, '[0-9]'))", "(length({0}) - length(replace({0}, chr(10), '')))"
HED, ADM = "regexp_matches({0}, '" + P.HEDGES + "')", "regexp_matches(correct, '" + P.ADMISSIONS.replace("'", "''") + "')"


@query(
    f"""with {POOL} select {RATE(HED.format('correct'))} as hedge_correct, {RATE(HED.format('wrong'))} as hedge_wrong, {RATE(DIG.format('correct') + '>' + DIG.format('wrong'))} as digits_correct,
 {RATE(DIG.format('wrong') + '>' + DIG.format('correct'))} as digits_wrong, {RATE(LIN.format('correct') + '>' + LIN.format('wrong'))} as lines_correct, {RATE(LIN.format('wrong') + '>' + LIN.format('correct'))} as lines_wrong,
 {RATE(ADM)} as admits from pool"""
)
def pool_leakage_hints(spark, sf_dir):
    return rounded(P.leakage_rates(B.pool_items(spark, sf_dir)))


@query(
    f"""with {POOL}, r as (select {', '.join(f"avg(({HED.format(c)})::INT) as h_{c}, avg(({DIG.format(c)} > {DIG.format(o)})::INT) as d_{c}, avg(({LIN.format(c)} > {LIN.format(o)})::INT) as l_{c}" for c, o in (('correct', 'wrong'), ('wrong', 'correct')))},
 avg(({ADM})::INT) as a from pool where correct like 'A%' or length(correct) > length(wrong)) select warning from (select unnest([case when abs(h_correct - h_wrong) > 0.25 then 'hedging-language imbalance' end,
 case when abs(d_correct - d_wrong) > 0.3 then 'numeric-density asymmetry' end, case when abs(l_correct - l_wrong) > 0.3 then 'line-count asymmetry' end,
 case when a > 0.05 then 'correct answers express uncertainty' end]) as warning from r) where warning is not null"""
)
def pool_leakage_warnings(spark, sf_dir):
    """Warnings about the items whose correct side is the longer one or begins with A."""
    return P.leakage_hints(B.pool_items(spark, sf_dir).where("correct like 'A%' or char_length(correct) > char_length(wrong)"))


@query(f"with {POOL} select id as item_id, coalesce(domain, 'none') as domain, round({GAP},9) as signed_length_gap from pool")
def pool_records(spark, sf_dir):
    """The pool goes through JSON lines, is read back and exported with its gaps."""
    at = working_folder(spark, "pool")
    items = B.pool_items(spark, sf_dir).withColumn("domain", F.coalesce("domain", F.lit("none")))
    items.select("id", "domain", "question", "correct", "wrong").write.json(at)
    return rounded(S.pool_records(S.load_items(spark, at, comments=False, check_domains=False)))


@query(
    f"""with {POOL}, {FAULTS}, {TRIVIAL}, g as (select {GAP} as gap from faulty), e as (select (select count(*) from trivial) + (select count(*) - count(distinct id) from faulty) as errors)
 select count(*) as n, any_value(errors)::BIGINT as errors, round(avg(gap),9) as mean_gap, round(avg((abs(gap) > 0.15)::INT),9) as over_share,
 any_value(errors) = 0 and abs(avg(gap)) <= 0.05 and avg((abs(gap) > 0.15)::INT) <= 0.1 as passed from g, e"""
)
def pool_gate(spark, sf_dir):
    return rounded(P.gate(faulty_pool(spark, sf_dir)))


BARE = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
FP = lambda x: f"substr(sha256({BARE(x)}),1,16)"
CANDIDATES = lambda table, seq: CUT(f"select 'c'||({seq}) as id, {seq} as seq, text from {table} where text is not null")
AUDIT = f"""with c0 as (select seq, question, correct, wrong from {CANDIDATES('documents', 'doc_id')}
 union all select seq, question, correct, wrong from {CANDIDATES('benchmark', '1000000000 + item_id')}),
 c1 as (select seq, {STRIP('question')} as q, {STRIP('correct')} as c, {STRIP('wrong')} as w from c0), c2 as (select *, {FP('q')} as fp,
 case when q='' or c='' or w='' then 'empty field' end as first_reason, case when {BARE('c')} = {BARE('w')} then 'answers identical'
 when length(c)/greatest(length(w),1)::DOUBLE < 0.5 or length(c)/greatest(length(w),1)::DOUBLE > 2.0 then 'answer length ratio '||printf('%.2f', length(c)/greatest(length(w),1)::DOUBLE)
 when length(q) < 15 or length(c) < 25 or length(w) < 25 then 'too short'
 else case {' '.join(f"when contains(lower(c),{text(m)}) or contains(lower(w),{text(m)}) then {text(f'contains {chr(39)}{m}{chr(39)}')}" for m in P.MARKERS)} end end as later from c1),
 old as (select distinct {FP(STRIP('question'))} as fp from {CANDIDATES('benchmark', '1000000000 + item_id')}),
 win as (select fp, min(seq) as winner from c2 where first_reason is null and later is null group by fp)
 select seq, coalesce(first_reason, case when old.fp is not null or winner < seq then 'duplicate' end, later) as reason from c2 left join old using (fp) left join win using (fp)"""


@query(AUDIT)
def candidate_audit(spark, sf_dir):
    def candidates(rows: DataFrame, seq: Column) -> DataFrame:
        cut = B.parts(F.col("text"), F.concat(F.lit("c"), seq.cast("string")))
        return rows.where("text is not null").select(seq.alias("seq"), *[c.alias(name) for name, c in cut.items()])

    docs = candidates(B.documents(spark, sf_dir), F.col("doc_id"))
    bench = candidates(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), F.col("item_id") + 1000000000)
    known = bench.select(C.fingerprint(C.strip("question")).alias("fp"))
    return P.audit(docs.unionByName(bench), known).select("seq", "reason")


LANGS = ("en", "fr", "de", "es")


@query(
    f"""with {POOL} select id, row_number() over (partition by domain order by pos) - 1 as turn, case domain {' '.join(f"when '{d}' then {i}" for i, d in enumerate(LANGS))} end as domain_rank from pool"""
)
def pool_interleave(spark, sf_dir):
    return P.interleaved(B.pool_items(spark, sf_dir), LANGS, bucket=F.floor(F.col("pos") / 65536)).select("id", F.col("turn").cast("long").alias("turn"), "domain_rank")


@query(f"with {POOL} select domain, count(*) as n from pool group by domain")
def domain_counts(spark, sf_dir):
    return P.domain_counts(B.pool_items(spark, sf_dir))


@query(
    f"""with {POOL} select id, round(((row_number() over (partition by domain order by sha256(id)) - 1)/greatest(count(*) over (partition by domain) - 1, 1)::DOUBLE - 0.5)*0.65, 9) as "offset" from pool"""
)
def mark_offsets(spark, sf_dir):
    return rounded(P.mark_offsets(B.pool_items(spark, sf_dir)).select("id", "offset"))


@query(
    f"with {POOL} select id, 2 as n, md5(question) as q from pool"
)
def extract_json_array(spark, sf_dir):
    items = B.pool_items(spark, sf_dir)
    row = F.to_json(F.array(F.struct("question", "correct", "wrong"), F.struct("question", F.col("wrong").alias("correct"), F.col("correct").alias("wrong"))))
    answer = F.concat(F.lit("Sure, here you are:\n"), row, F.lit("\nDone."))
    found = items.select("id", P.candidates_of(answer).alias("a"))
    return found.select("id", F.size("a").alias("n"), F.md5(F.get(F.col("a"), F.lit(1))["question"]).alias("q"))


def log_lines(rows: DataFrame) -> DataFrame:
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)) for f in S.JUDGMENT])


def appended_log(spark: SparkSession, sf_dir: str, at: str) -> None:
    """All judgments as a log; then a second append that repeats some with another verdict, then torn lines."""
    log = log_lines(judgments(spark, sf_dir).withColumn("is_correct", F.col("verdict") == F.col("preferred")))
    again = files.stored(log.where(C.uniform("again", F.col("key")) < 0.03), "again")
    O.write_log(log, at, append=False)
    O.write_log(again.withColumn("verdict", F.lit("TIE")), at, append=True)
    again.select(F.substring(F.to_json(F.struct("*")), 1, 60).alias("value")).write.mode("append").text(at, compression="gzip")


LOGGED = f"with {JUDGED} select judge_id, axis, verdict, count(*) as n from judged group by all"


@query(LOGGED)
def ingest_stream_dedup(spark, sf_dir):
    """The log goes through JSON files, with repeats and torn lines, and a stream; what comes out is counted."""
    at = working_folder(spark, "stream")
    appended_log(spark, sf_dir, f"{at}/log")
    ingest(spark, f"{at}/log", f"{at}/table", f"{at}/state")
    return spark.read.parquet(f"{at}/table").groupBy("judge_id", "axis", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(LOGGED)
def log_first_append_wins(spark, sf_dir):
    """The same log read at once: the first row of each key in the order of appends, though all files have one time."""
    at = working_folder(spark, "log")
    appended_log(spark, sf_dir, at)
    files.set_times(at, 0)
    first = K.first_by_key(S.load_log(spark, at, ["judge_id", "axis", "key"]), S.LOG_ORDER)
    return first.groupBy("judge_id", "axis", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with g as (select coalesce(lang, 'none') as run_id, count(*) as n, min(doc_id) as lo from documents group by 1),
 e as (select run_id, unnest(['schema', 'items_sha256', 'judges', 'code_commit', 'config.reps', 'config.seed', 'config.axes', 'config.odd']) as field,
  unnest(['3', sha256(n::VARCHAR), '[{"judge_id":"'||run_id||'"}]', case when n % 2 = 1 then 'unknown' else 'c'||n end, (n % 3)::VARCHAR, coalesce(lo::VARCHAR, 'none'), '["length"]', case when n % 2 = 1 then 'true' end]) as value from g),
 f as (select * from e where value is not null), base as (select min(run_id) as b from g),
 w as (select r.run_id, f.field, f.value as wanted from (select run_id from g, base where run_id <> b) r, f, base where f.run_id = b), o as (select f.* from f, base where run_id <> b)
 select run_id, field, wanted, value from w full join o using (run_id, field) where wanted is distinct from value
  and not (field = 'code_commit' and coalesce(wanted = 'unknown' or value = 'unknown', true))"""
)
def manifest_differences(spark, sf_dir):
    """A run for each language, its settings made of that language's documents, held against the first of them."""
    at = working_folder(spark, "manifests")
    lang = F.coalesce("lang", F.lit("none"))
    runs = B.documents(spark, sf_dir).groupBy(lang.alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo")).collect()
    for r in runs:
        odd = r.n % 2 == 1
        config = {"reps": r.n % 3, "seed": "none" if r.lo is None else r.lo, "axes": ["length"], "folder": at} | ({"odd": True} if odd else {})
        made = {"run_id": r.run_id, "schema": 3, "items_sha256": hashlib.sha256(str(r.n).encode()).hexdigest(), "judges": [{"judge_id": r.run_id}], "code_commit": "unknown" if odd else f"c{r.n}", "config": config}
        O.write_json(f"{at}/{r.run_id}_manifest.json", made)
    return manifests.differences(manifests.entries(spark, at), min(r.run_id for r in runs))
