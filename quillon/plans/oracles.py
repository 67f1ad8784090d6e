"""DuckDB SQL equal to the registered queries."""

from __future__ import annotations

from quillon.functions.protein import AMBIGUOUS, MASSES, STRICT, WATER, _masses
from quillon.functions.qvalue import LAMBDAS
from quillon.plans.queries import CONDITIONS, CONFIG

IN = ", ".join(f"'{s}'" for s in sorted(CONFIG.selected_sample_ids))
CASE = "case " + " ".join(f"when sample_id in ({', '.join(repr(s) for s in v)}) then '{k}'" for k, v in CONDITIONS.items())
LONG = "e as (select l_suppkey::varchar protein_id, p_type peptide_id, 'Y' || year(l_shipdate) sample_id, avg(l_extendedprice) intensity, count(*) % 3 <> 0 is_real, count(*) % 2 = 0 is_complete_missing from lineitem join part on l_partkey = p_partkey group by all)"
NORMAL = f"""{LONG},
s as (select *, {CASE} end condition, log2(intensity) y from e where sample_id in ({IN})),
t as (select *, (y - avg(y) over (partition by sample_id)) / stddev_samp(y) over (partition by sample_id) z from s),
n as (select *, z - avg(z) filter (condition = 'control') over (partition by protein_id, peptide_id) v from t)"""
TIERS = "case when is_real then 1.0 when is_complete_missing then 0.5 else 1e-5 end::double"


def stats(weight: str = "1.0::double", where: str = "true") -> str:
    return f"""{NORMAL},
c0 as (select *, v - avg(v) over (partition by protein_id, condition) u, {weight} w from n where {where}),
c1 as (select protein_id, peptide_id, condition, count(*) n, sum(w) w1, sum(w * u) s1, sum(w * u * u) q1 from c0 group by all),
c as (select *, sum(w1) over p - w1 w0, sum(s1) over p - s1 s0, sum(q1) over p - q1 q0, count(*) over p n_peptides, (sum(n) over (partition by protein_id))::bigint n_all from c1 window p as (partition by protein_id, condition)),
d as (select *, 1 / (1 / w1 + 1 / w0) cc, s1 / w1 - s0 / w0 dd, q1 - s1 * s1 / w1 + q0 - s0 * s0 / w0 rr from c),
f as (select protein_id, peptide_id, max(n_all) n_rows, count(*) n_cells, sum(rr) ssr, sum(cc * dd * dd) - sum(cc * dd) * sum(cc * dd) / sum(cc) wald_sum, max(n_all) - 6 df from d group by all),
g as (select *, case when df <= 0 then 'insufficient_df' when n_cells < 3 then 'ill_conditioned' when ssr <= 0 then 'zero_scale' else 'ok' end fit_status from f),
p as (select protein_id, peptide_id, case when fit_status = 'ok' then pow(1 + wald_sum / (ssr / df) / df, -df / 2.0) end raw_p_value, fit_status from g)"""


def adjusted(method: str, over: str = "", source: str = "p", column: str = "raw_p_value") -> str:
    """Ranked correction of a column, over all rows or by protein."""
    by = f"partition by {over}" if over else ""
    m = f"count({column}) over ({by})"
    up = f"order by {column} nulls last"
    low, high = f"rank() over ({by} {up})", f"count({column}) over ({by} {up} range between unbounded preceding and current row)"
    bound = {
        "bonferroni": f"{column} * {m}",
        "holm": f"least(1, {column} * ({m} - {low} + 1))",
        "hochberg": f"{column} * ({m} - {high} + 1)",
        "fdr_bh": f"{m} / {high} * {column}",
        "by": f"{m} / {high} * {column} * (select sum(1.0::double / i) from range(1, (select count(raw_p_value) from p) + 1) r(i))" if not over else f"{m} / {high} * {column} * list_sum([1.0::double / i for i in range(1, {m} + 1)])",
    }[method]
    run = {"bonferroni": "b", "holm": f"max(b) over ({by} order by {column} range between unbounded preceding and current row)"}.get(method, f"min(b) over ({by} order by {column} desc range between unbounded preceding and current row)")
    return f"select *, case when {column} is not null then least(1, {run}) end a from (select *, {bound} b from {source})"


HOMMEL_ALL = """, r as (select *, row_number() over (order by raw_p_value) i, count(*) over () m from p where raw_p_value is not null),
al as (select j, min(j * raw_p_value / (i - m + j)) a from r, (select unnest(range(1, (select count(*) + 1 from r))) j) where i > m - j group by all),
h as (select protein_id, peptide_id, least(1, max(least(j * raw_p_value, a))) adjusted from r, al group by all)
select protein_id, peptide_id, round(adjusted, 6) + 0 adjusted from p left join h using (protein_id, peptide_id)"""

HOMMEL = """, r as (select *, row_number() over (partition by protein_id order by raw_p_value) i, count(*) over (partition by protein_id) m from p where raw_p_value is not null),
al as (select x.protein_id, j, min(j * raw_p_value / (i - m + j)) a from r x, range(1, 50) t(j) where j <= m and i > m - j group by all),
h as (select r.protein_id, r.peptide_id, least(1, max(least(j * raw_p_value, a))) adjusted from r join al using (protein_id) group by all)
select protein_id, peptide_id, round(adjusted, 6) adjusted from h"""

ENTRIES = r"""k0 as (select *, p_partkey k, 'P' || lpad(p_partkey::varchar, 5, '0') || case when p_partkey % 7 = 0 then '-2' else '' end acc, upper(regexp_replace(p_name || p_type, '[^A-Za-z]', '', 'g')) letters from part),
en as (select k, case when k % 2 = 0 then 'sp' else 'tr' end || case when k % 11 = 0 then ' ' else '|' end || acc || '|' || acc || '_X ' || p_name || ' OS=Homo sapiens OX=' || p_size || case when k % 5 = 0 then '' else ' GN=G' || k end || ' PE=' || k % 5 || ' SV=x' header,
case when k % 3 = 0 then substr(letters, 1, 5) when k % 4 = 0 then regexp_replace(letters, '[OUBZJX]', 'G', 'g') else letters || case when k % 10 = 1 then '*' else '' end end sequence from k0)"""
PARSED = r""", h0 as (select *, string_split(header, '|') q from en), h1 as (select *, len(q) >= 3 and trim(q[2]) <> '' good, array_to_string(q[3:], '|') rest from h0),
h as (select *, case when instr(rest, ' ') > 0 then substr(rest, instr(rest, ' ') + 1) else '' end txt, coalesce(string_split(txt, 'OS=')[2], '') sp from h1)"""


def oracle_sql() -> dict[str, str]:
    r6 = lambda *cols: ", ".join(f"round({c}, 6) + 0 {c}" for c in cols)
    key = "protein_id, peptide_id"
    w, p = stats(), f"with {stats()}"
    letters = "".join(sorted(STRICT + "".join(AMBIGUOUS)))
    mass = " + ".join([str(WATER), *(f"(length(sequence) - length(replace(sequence, '{a}', ''))) * {m!r}" for a, m in sorted(_masses().items()))])
    out = {
        "scan_project_filter": f"with {LONG} select protein_id, peptide_id, sample_id, round(intensity, 6) intensity from e where sample_id in ({IN})",
        "harmonize_rename_cast": "select l_suppkey::varchar protein_id, l_linenumber::varchar peptide_id, l_orderkey::varchar sample_id, l_extendedprice intensity from lineitem",
        "protein_group_resolve": "with g as (select p_partkey, string_split(case when p_partkey % 4 = 0 then p_brand else p_name || ';P' || lpad(p_partkey::varchar, (4 + p_partkey % 3)::int, '0') || ';Q12345' end, ';') x from part) select p_partkey, coalesce([y for y in x if length(y) = 6][1], x[1]) accession from g",
        "attach_conditions": f"with {LONG} select protein_id, peptide_id, sample_id, case " + " ".join(f"when sample_id in ({', '.join(repr(s) for s in v[:2])}) then '{k}'" for k, v in CONDITIONS.items()) + " else sample_id end condition from e",
        "scope_audit": f"with {LONG}, h as (select distinct sample_id from e), a as (select unnest([{IN}, 'Y1900']) asked) select coalesce(sample_id, asked) sample, sample_id is not null present, asked is not null configured from h full join a on sample_id = asked",
        "duplicate_keys": "select l_suppkey protein_id, l_linenumber peptide_id, year(l_shipdate) sample_id, count(*) n from lineitem group by all having n > 1",
        "min_peptide_offenders": "select l_suppkey protein_id, count(distinct l_partkey) n_peptides from lineitem group by all having n_peptides < 520",
        "intensity_audit": "with x as (select case when l_orderkey % 97 = 0 then null when l_orderkey % 89 = 0 then 'nan'::double when l_orderkey % 83 = 0 then 'inf'::double when l_orderkey % 79 = 0 then -l_extendedprice else l_extendedprice end v from lineitem) select count(*) n_rows, count(*) filter (isnan(v) or isinf(v)) n_non_finite, count(*) filter (v is null) n_null, count(*) filter (v <= 0) n_non_positive, round(avg(isnan(v)::int), 6) nan_fraction from x",
        "provenance_join": f"with {LONG} select protein_id, peptide_id, sample_id, round(intensity, 6) intensity, is_real, is_complete_missing from e",
        "provenance_anti_missing": f"with {LONG} select protein_id, peptide_id, sample_id from e where ends_with(protein_id, '3')",
        "provenance_anti_extra": f"with {LONG} select protein_id, peptide_id, sample_id from e where ends_with(sample_id, '7')",
        "weight_tiers": f"with {LONG} select protein_id, peptide_id, sample_id, {TIERS} weight from e",
        "sample_stats": f"with {LONG} select sample_id, count(*) n, round(avg(log2(intensity)), 6) mean, round(stddev_samp(log2(intensity)), 6) std from e group by all",
        "normalize_long": f"with {NORMAL} select protein_id, peptide_id, sample_id, condition, round(v, 6) intensity_normalized from n",
        "peptide_codes": f"with {LONG} select distinct protein_id, peptide_id, dense_rank() over (partition by protein_id order by peptide_id) - 1 peptide_code from e",
        "protein_ordinal": f"with {LONG} select protein_id, row_number() over (order by protein_id) - 1 protein_index from (select distinct protein_id from e)",
        "wls_cells": f"with {w} select protein_id, peptide_id, condition, n, n_all, n_peptides, {r6('w1', 's1', 'q1', 'w0', 's0', 'q0')} from c",
        "wls_stat": f"with {w} select protein_id, peptide_id, n_rows, n_cells, df, {r6('ssr', 'wald_sum')} from f",
        "wls_pvalue": f"{p} select {key}, {r6('raw_p_value')}, fit_status from p",
        "wls_weighted_pvalue": f"with {stats(TIERS)} select {key}, {r6('raw_p_value')}, fit_status from p",
        "fit_status_counts": f"""with {stats(where="not (ends_with(protein_id, '5') and condition = 'mid' and peptide_id = 'ECONOMY')")} select fit_status, count(*) n from p group by all""",
        "adjust_hommel": p + HOMMEL_ALL,
        "adjust_hommel_within": p + HOMMEL,
        "pi0_lambda_curve": f"{p}, l as (select unnest([{', '.join(repr(float(x)) for x in LAMBDAS)}]) lam), m as (select count(raw_p_value) m from p) select round(lam, 2) \"lambda\", (select count(*) from p where raw_p_value > lam) n_above, round((select count(*) from p where raw_p_value > lam) / (m * (1 - lam)), 6) pi0 from l, m",
        "pi0_bootstrap": f"{p}, l as (select unnest([{', '.join(repr(float(x)) for x in LAMBDAS)}]) lam), m as (select count(raw_p_value) m from p), b_counts as (select lam, m, (select count(*) from p where raw_p_value > lam) n from l, m), b_curve as (select *, n / (m * (1 - lam)) pi0 from b_counts), b_errors as (select pi0, n / (m::double * m * (1 - lam) * (1 - lam)) * (1 - n / m) + power(pi0 - (select quantile_cont(pi0, 0.1) from b_curve), 2) error from b_curve) select round(least(1.0, coalesce((select pi0 from b_errors order by error, pi0 limit 1), 1.0)), 6) pi0",
        "discordance_wls": f"with {stats(TIERS)}, q as ({adjusted('bonferroni', 'protein_id')}), x as (select protein_id, peptide_id, raw_p_value, fit_status, a within_p_value from q), y as ({adjusted('fdr_bh', '', 'x', 'within_p_value')}) select {key}, round(raw_p_value, 6) raw_p_value, round(within_p_value, 6) within_p_value, round(a, 6) adjusted_p_value, coalesce(a <= {CONFIG.fdr}, false) is_discordant, fit_status from y",
        "condition_profiles": f"with {NORMAL} select protein_id, peptide_id, condition, round(median(v), 6) + 0 \"value\" from n group by all",
        "dpf_assignment": f"{p}, l as (select {key}, raw_p_value < 0.3 is_discordant, case when peptide_id < 'L' then 1 when peptide_id < 'Q' then 2 else 3 end::bigint cluster_id from p), gr as (select protein_id, cluster_id, count(*) n, bool_or(is_discordant) hit from l group by all), u as (select protein_id, cluster_id, case when not hit then 0 when n = 1 then -1 else sum((hit and n > 1)::int) over (partition by protein_id order by cluster_id) end::bigint dpf_id from gr) select {key}, is_discordant, cluster_id, dpf_id from l join u using (protein_id, cluster_id)",
        "sequence_validity": f"with {ENTRIES} select k, regexp_full_match(sequence, '[{letters}]+') valid, regexp_full_match(sequence, '[{''.join(sorted(MASSES))}]+') valid_strict from en",
        "molecular_weight": f"with {ENTRIES} select k, round(({mass}) / 1000, 6) kda from en where regexp_full_match(sequence, '[{letters}]+')",
    }
    medians = f"with {NORMAL}, m as (select protein_id, peptide_id, condition, median(v) x from n group by all)"
    pairs = ", d as (select a.protein_id, a.peptide_id a, b.peptide_id b, sqrt(sum((a.x - b.x) * (a.x - b.x))) distance from m a join m b on a.protein_id = b.protein_id and a.condition = b.condition and a.peptide_id <> b.peptide_id group by all)"
    out["profile_distances"] = f"{medians}{pairs} select protein_id, a, b, round(distance, 6) distance from d where a < b"
    out["silhouette_given_labels"] = (
        f"{medians}{pairs}, o as (select protein_id, a, avg(distance) filter ((a < 'M') = (b < 'M')) own, avg(distance) filter ((a < 'M') <> (b < 'M')) other from d group by all)"
        " select protein_id, a peptide_id, round(case when own is null or other is null or greatest(own, other) = 0 then 0 else (other - own) / greatest(own, other) end, 6) score from o"
    )
    out["dpf_counts"] = f"select dpf_id, count(*) n, count(*) filter (is_discordant) n_discordant from ({out['dpf_assignment']}) group by all"
    for name in ("bonferroni", "holm", "hochberg", "fdr_bh", "by"):
        out[f"adjust_{name}"] = f"{p}, q as ({adjusted(name)}) select {key}, round(a, 6) adjusted from q"
        out[f"adjust_{name}_within"] = f"{p}, q as ({adjusted(name, 'protein_id')}) select {key}, round(a, 6) adjusted from q"
    good = lambda x, c: f"case when good then ({x})::varchar end \"{c}\""
    number = lambda t: f"try_cast(nullif(regexp_extract(txt, '{t}=(\\S+)', 1), '') as bigint)"
    fields = {
        "reviewStatus": "case when trim(q[1]) = 'sp' then 'reviewed' else 'unreviewed' end", "entry": "trim(q[2])", "entryName": "string_split(rest, ' ')[1]", "proteinDescription": "nullif(trim(string_split(txt, ' OS=')[1]), '')",
        "geneName": "nullif(regexp_extract(txt, 'GN=(\\S+)', 1), '')", "organism": "nullif(trim(substr(sp, 1, coalesce(list_min([x for x in [instr(sp, ' OX='), instr(sp, ' GN='), instr(sp, ' PE='), instr(sp, ' SV=')] if x > 0]) - 1, length(sp)))), '')", "taxonomyId": number("OX"), "proteinExistence": number("PE"), "sequenceVersion": number("SV"),
    }
    out["fasta_header_parse"] = f"with {ENTRIES}{PARSED} select k, {', '.join(good(x, c) for c, x in fields.items())} from h"
    out["fasta_skip_counts"] = (
        f"with {ENTRIES}{PARSED}, x as (select case when length(sequence) < 7 then 'length_filter' when not good then 'malformed_header' when k % 5 = 0 then 'gene_filter' when not regexp_full_match(sequence, '[{''.join(sorted(MASSES))}]+') then 'invalid_sequence' end skip_reason from h)"
        " select r.skip_reason, count(x.skip_reason) filter (true) + count(*) filter (r.skip_reason is null and x.hit) n from (values ('length_filter'), ('malformed_header'), ('gene_filter'), ('invalid_sequence'), (null)) r(skip_reason) left join (select *, true hit from x) x on r.skip_reason is not distinct from x.skip_reason group by all"
    )
    return out
