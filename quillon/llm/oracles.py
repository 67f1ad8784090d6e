"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quillon.llm import jaccard, mixing, quality, urls, warc

WORD = r"[^\x20\x09-\x0D]+"


def urls_sql() -> str:
    rules = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def case(value) -> str:
        return "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{value(v, h, p)}'" for v, h, p in rules) + " end"

    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda x: low(f"regexp_extract(coalesce({x}, ''), '{urls.URL}', 1)")
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    damp = urls.SHARE * urls.DAMP_UP // urls.DAMP_DOWN
    parts = [
        f"named0 as (select page_id, {host('url')} host, regexp_extract(coalesce(url, ''), '{urls.URL}', 2) path from pages)",
        f"named as (select *, {case(lambda v, h, p: h + p)} as rule, {case(lambda v, h, p: v)} rule_verdict from named0)",
        "hosts as (select host, count(*) n, count(*) filter (rule_verdict = 'allow') a, count(*) filter (rule_verdict = 'block') b from named group by host)",
        f"r0 as materialized (select host, k kind, ((case k when 0 then a else b end * {urls.UNIT}::hugeint // n) * {urls.DAMP_DOWN - urls.DAMP_UP} // {urls.DAMP_DOWN})::hugeint score from hosts, (values (0), (1)) t(k))",
        f"e0 as (select {host('url')} src, unnest(regexp_extract_all(coalesce(html, ''), {quoted(urls.LINK)})) link from pages)",
        f"e1 as (select src, regexp_extract(link, {quoted(urls.LINK)}, 1) || regexp_extract(link, {quoted(urls.LINK)}, 2) || regexp_extract(link, {quoted(urls.LINK)}, 3) href from e0)",
        f"e2 as (select src, {host("case when starts_with(href, '//') then 'http:' || href else href end")} dst from e1 where contains(href, '//'))",
        "e as materialized (select src, dst, count(*) links from e2 where dst <> '' and src <> '' and src <> dst group by all)",
        f"l as materialized (select src, dst, 0 kind, links * {damp} // sum(links) over (partition by src) share from e union all select dst, src, 1, links * {damp} // sum(links) over (partition by dst) from e)",
    ]
    for k in range(urls.STEPS):
        parts.append(f"r{k + 1} as (select host, kind, sum(score)::hugeint score from (select * from r0 union all select dst, r.kind, (score * share::hugeint // {urls.SHARE})::hugeint from r{k} r join l on r.host = l.src and r.kind = l.kind) group by host, kind)")
    parts.append(f"h as materialized (select host, coalesce(sum(score) filter (kind = 0), 0) trust, coalesce(sum(score) filter (kind = 1), 0) distrust from r{urls.STEPS} group by host)")
    parts.append(f"m as (select src, sum(links::hugeint * least(coalesce(distrust, 0), {urls.FULL})::hugeint)::hugeint // sum(links)::hugeint aim from e left join h on dst = host group by src)")
    own = f"case when greatest(distrust, coalesce(aim, 0)) >= {urls.BLOCK_AT} and greatest(distrust, coalesce(aim, 0)) > trust then 'block' else 'allow' end"
    return "with " + ", ".join(parts) + f" select page_id, named.host, path, rule, coalesce(rule_verdict, {own}) verdict from named left join h on named.host = h.host left join m on named.host = m.src"


def quality_sql() -> str:
    m, w = len(quality.RULES), quality.WINDOW
    drop = lambda cls: f"(length(t) - length(regexp_replace(t, '{cls}', '', 'g')))"
    odds = lambda p: f"ln({p} / (1 - {p}))"
    parts = [
        f"d as (select row_number() over () rid, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') w, [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{WORD}')] l from documents)",
        f"win as (select rid, i, array_to_string(w[i:i+{w - 1}], ' ') g from (select rid, w, unnest(range(1, len(w) - {w - 2})) i from d))",
        "rep as (select distinct rid, i + o p from (select rid, i, count(*) over (partition by rid, g) c from win), (select unnest(range(0, %d)) o) where c > 1)" % w,
        "nrep as (select rid, count(*) n from rep group by rid)",
        "c as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(list_distinct(w))::bigint n_distinct, %s n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, len(l)::bigint n_lines, %s n_upper, %s n_marks, coalesce(n, 0)::bigint n_repeat_words from d left join nrep using (rid))" % (drop("[#*$%&|<>]"), drop("[A-Z]"), drop("!")),
        f"j as (select *, ({quality.base_failed()}) base_failed, ({quality.pattern_code()})::bigint pattern from c)",
        f"p as (select pattern, n, [((pattern // power(3, k)::bigint) % 3 - 1)::int for k in range(0, {m})] v from (select pattern, count(*)::double n from j group by pattern))",
        f"q0 as (select pattern, n, v, case when list_contains(v, -1) then {1 - quality.FIRST}::double else {quality.FIRST}::double end q from p)",
    ]
    weigh = lambda k, vote: f"ln(((sum(case when v[{k}] = {vote} then n * q else 0 end) + 1) / (sum(n * q) + 3)) / ((sum(case when v[{k}] = {vote} then n * (1 - q) else 0 end) + 1) / (sum(n * (1 - q)) + 3)))"
    said = f"list_sum([case when v[k + 1] < 0 then against[k + 1] when v[k + 1] > 0 then speaks[k + 1] else 0 end for k in range(0, {m})])"
    for i in range(quality.ROUNDS):
        against, speaks = (", ".join(f"{bound}({weigh(k, vote)}, 0)" for k in range(1, m + 1)) for vote, bound in ((-1, "least"), (1, "greatest")))
        parts.append(f"s{i} as materialized (select (sum(n * q) + 1) / (sum(n * q) + sum(n * (1 - q)) + 2) prior, [{against}] against, [{speaks}] speaks from q{i})")
        parts.append(f"q{i + 1} as (select pattern, n, v, 1 / (1 + exp(-({odds('prior')} + {said}))) q from p, s{i})")
    parts.append(f"f as (select pattern, q posterior from q{quality.ROUNDS})")
    return "with " + ", ".join(parts) + f" select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and posterior >= {quality.KEEP_AT} kept from j join f using (pattern)"


def targets_cte(cap: float = 3.0) -> list[str]:
    """From size rows b(source, size) to t(source, source_size, target)."""
    return [
        "src as (select source, sum(size)::bigint source_size from b group by source)",
        f"ranked as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 weight, source_size * {cap}::double most from src)",
        "fill as (select *, (sum(source_size) over ())::double - coalesce(sum(most) over win, 0) left_size, sum(weight) over () - coalesce(sum(weight) over win, 0) left_weight from ranked window win as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding))",
        "caps as (select *, most * left_weight <= left_size * weight capped from fill)",
        "t as (select source, source_size, case when capped then most else (max(left_size) filter (not capped) over ()) * weight / (max(left_weight) filter (not capped) over ())::double end target from caps)",
    ]


def mixing_parts(table: str, size: str) -> list[str]:
    """CTEs up to mixed(doc columns of table, size, source_size, target, copies)."""
    digits = mixing.DIGITS * mixing.LEVELS
    parts = [f"b as (select *, ({size})::bigint size, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ' ' || coalesce(text, '')), 1, {digits}))::bigint h from {table})", *targets_cte()]
    parts.append("plan as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint copies0 from t)")
    parts.append("cut0 as (select source, 0::bigint prefix, floor(target)::bigint - copies0 * source_size rest, 0::bigint edge from plan)")
    for k in range(mixing.LEVELS):
        low = 16 ** (mixing.DIGITS * (mixing.LEVELS - 1 - k))
        parts.append(f"bins{k} as (select b.source, rest, h // {low} bin, sum(size)::bigint size from b join cut{k} c on b.source is not distinct from c.source and h // {low * mixing.BINS} = prefix group by all)")
        parts.append(f"run{k} as (select *, sum(size) over (partition by source order by bin)::bigint upto from bins{k})")
        parts.append(f"cut{k + 1} as (select source, arg_min(bin, bin) prefix, arg_min(rest - upto + size, bin)::bigint rest, arg_min(size, bin)::bigint edge from run{k} where upto > rest group by source)")
    n = mixing.LEVELS
    parts.append(f"mixed as (select b.*, p.source_size, p.target, (copies0 + case when c.prefix is null then 0 when b.h < c.prefix + case when 2 * c.rest > c.edge then 1 else 0 end then 1 else 0 end)::bigint copies from b join plan p on b.source is not distinct from p.source left join cut{n} c on b.source is not distinct from c.source)")
    return parts


def mixing_sql() -> str:
    return "with " + ", ".join(mixing_parts("documents", f"len(regexp_extract_all(coalesce(text, ''), '{WORD}'))")) + " select doc_id, size, source_size, target, size * copies taken from mixed"


def substring_sql() -> str:
    parts = [
        f"w as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents)",
        "win as (select rid, doc_id, i, array_to_string(w[i:i+12], ' ') g from (select rid, doc_id, w, unnest(range(1, len(w) - 11)) i from w))",
        "rep as (select rid, i from (select rid, doc_id, i, min(doc_id) over (partition by g) first from win) where first < doc_id)",
        "gone as (select distinct rid, i + o p from rep, (select unnest(range(0, 13)) o))",
        "lists as (select rid, list(p) p from gone group by rid)",
        "kept as (select doc_id, w, len(p) n, case when p is null then w else (select list(x order by k) from (select unnest(w) x, unnest(range(1, len(w) + 1)) k) where not list_contains(p, k)) end kept from w left join lists using (rid))",
    ]
    return "with " + ", ".join(parts) + " select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) kept_sha256 from kept"


def jaccard_sql() -> str:
    size = jaccard.SIZE
    parts = [
        f"d as materialized (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents)",
        f"s as materialized (select distinct rid, array_to_string(w[i:i+{size - 1}], ' ') g from (select rid, w, unnest(range(1, greatest(len(w) - {size - 2}, least(len(w), 1) + 1))) i from d))",
        "n as materialized (select rid, doc_id, count(g) n from d left join s using (rid) group by rid, doc_id)",
        "met as (select a.rid a, b.rid b, count(*) c from s a join s b on a.g = b.g and a.rid < b.rid group by all)",
        "pairs as materialized (select a, b, 2 * c = x.n + y.n copy from met join n x on x.rid = a join n y on y.rid = b where 9 * c >= 4 * (x.n + y.n))",
        "links as materialized (select a, b, copy from pairs union all select b, a, copy from pairs)",
    ]
    reach = "reach(rid, other) as (select rid, rid from n union select reach.rid, b from reach join links on other = a)"
    return (
        "with recursive " + ", ".join([*parts, reach])
        + " select n.doc_id, r.class_id, coalesce(l.n_links, 0)::bigint n_links, least(n.doc_id, c.copy_id) copy_id, n.n::bigint n_shingles from n"
        " join (select reach.rid, min(m.doc_id) class_id from reach join n m on m.rid = other group by reach.rid) r on r.rid = n.rid"
        " left join (select a, count(*) n_links from links group by a) l on l.a = n.rid"
        " left join (select a, min(m.doc_id) copy_id from links join n m on m.rid = b where copy group by a) c on c.a = n.rid"
    )


def warc_sql() -> str:
    return f"""with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n from pages),
k as (select *, case when n >= {warc.LEAST} then max(page_id) over (partition by h) end keeper from p)
select page_id, n::bigint payload_bytes, sha1(h) payload_digest, case when keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end record_type,
case when page_id is distinct from keeper then keeper end refers_to from k"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_trust": urls_sql(), "op2_quality_votes": quality_sql(), "op4_repeated_spans": substring_sql(), "op6_mix_sources": mixing_sql(), "op8_near_duplicates": jaccard_sql(), "op9_warc_packages": warc_sql()}
