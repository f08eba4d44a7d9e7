"""Registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import (
    byte_repeats, conversations, decontamination, html_text, licenses, merkle, mixing, personal_data, quality, simhash,
    substrings, topk, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op2_mixing_weights")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "labels"), mixing.TARGETS, F.col("lang"))


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query("op4_substring_dedup", """
with d as (select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents),
s as (select r, ws, unnest(range(1, len(ws) - 33)) as s from d where len(ws) >= 35),
w as (select r, s, md5(array_to_string(ws[s:s + 34], ' ')) as k from s),
twice as (select r, s from w where k in (select k from w group by k having count(*) > 1)),
gone as (select distinct r, unnest(range(s, s + 35)) as p from twice),
words as (select r, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from d),
kept as (select words.r, count(gone.p)::bigint as n_removed, string_agg(w, ' ' order by words.p) filter (where gone.p is null) as t
  from words left join gone on gone.r = words.r and gone.p = words.p group by words.r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_personal_data")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.report(_table(spark, folder, "documents"))


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def line(c: str) -> str:
        c = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        c = f"regexp_replace({c}, {quote(licenses.COPYRIGHT_LINE)}, '')"
        for pattern, to in licenses.LINE_RULES:
            c = f"regexp_replace({c}, {quote(pattern)}, {quote(to)}, 'g')"
        return f"trim({c}, ' ')"

    def words(c: str) -> str:
        c = f"' ' || {c} || ' '"
        for pattern, to in licenses.SPELLINGS:
            end = "" if pattern.endswith(")") else " "
            c = f"regexp_replace({c}, {quote(' ' + pattern + end)}, {quote(' ' + to + end)}, 'g')"
        return f"trim({c}, ' ')"

    def split(c: str) -> str:
        lines = f"list_transform(regexp_split_to_array({c}, '\\r?\\n|\\r'), lambda l: {line('l')})"
        return f"list_filter({lines}, lambda l: l <> '')"

    known = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in licenses.KNOWN)
    paragraph = "'(?:\\r?\\n|\\r)[\\x20\\t]*(?:\\r?\\n|\\r)+'"
    return f"""
with known as (select distinct license, sha256({words(f"array_to_string({split('text')}, ' ')")}) as digest
  from (values {known}) as k(license, text)),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
u as (select r, 'line' as scope, unnest({split('text')}) as c from d
  union all select r, 'paragraph', array_to_string({split('p')}, ' ')
    from (select r, unnest(regexp_split_to_array(text, {paragraph})) as p from d)
  union all select r, 'text', array_to_string({split('text')}, ' ') from d),
hits as (select r, scope, license from u join known on digest = sha256({words('c')}) where c <> '')
select doc_id, count(license)::bigint as n_matches,
  coalesce(string_agg(distinct license, ',' order by license), '') as licenses,
  coalesce(bool_or(scope = 'text'), false) as is_license
from d left join hits using (r) group by r, doc_id"""


@query("op6_license_scan", _license_sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality.grades(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query("op8_benchmark_decontamination", """
with dw as (select rowid as row, doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as ws
       from (select row_number() over () as rowid, * from documents)),
iw as (select distinct item_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as ws from benchmark),
win as (select distinct item_id, least(len(ws), 10) as n,
          array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') as w
        from iw, lateral (select unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as s) where len(ws) > 0),
widths as (select distinct n from win),
cand as (select row, n, s, array_to_string(ws[s:s + n - 1], ' ') as w
         from dw, widths, lateral (select unnest(range(1, len(ws) - n + 2)) as s) where len(ws) >= n),
hits as (select row, c.n, s, item_id from cand c join win using (n, w)),
words as (select row, count(distinct p)::bigint as n_hit
          from (select row, unnest(range(s, s + n)) as p from (select distinct row, n, s from hits)) group by row),
ids as (select row, count(*)::bigint as n_items, string_agg(i, ',' order by i) as l
        from (select distinct row, item_id::varchar as i from hits) group by row)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (row) left join ids using (row)""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


@query("op10_exact_top_k", """
with v as (select vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)::bigint) as v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding::double[], lambda x: isfinite(x))) = len(embedding)),
s as (select q.vec_id as query_id, c.vec_id,
        list_inner_product(q.v::double[], c.v::double[])::bigint as score
      from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 20""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, folder, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors)


def _merkle_sql(levels: int = 8) -> str:
    """Leaves and their siblings level by level; a tree of one node stays as it is (up to 16**levels leaves)."""
    # The table of the CRC-32 polynomial, worked out by the query.
    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i))"
    crc = ("xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint),"
           " lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)")
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def digest(text: str) -> str:
        parts = [f"coalesce(octet_length(encode(({c})::varchar))::varchar || ':' || ({c})::varchar, '-')"
                 for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    def up(prefix: str, start: str) -> str:
        out = [f"{prefix}0 as ({start})"]
        for k in range(levels):
            out.append(f"{prefix}r{k} as (select tree, pos // 16 as run, list(digest order by pos) as ds, any_value(n) as n from {prefix}{k} group by all)")
            out.append(f"{prefix}{k + 1} as (select tree, run as pos, (n + 15) // 16 as n, case when n > 1 then sha256(array_to_string(ds, '')) else ds[1] end as digest from {prefix}r{k})")
        return ", ".join(out)

    def climb(prefix: str, leaf: str) -> str:
        """Columns left and right of each level below, and the fold, as nested subqueries."""
        query = leaf
        for k in range(levels):
            slot = f"(place // {16 ** k}) % 16"
            query = (f"select q.* exclude (proof, folded), proof || case when r.n > 1 then array_to_string(r.ds[1:{slot}], '') || array_to_string(r.ds[{slot} + 2:], '') else '' end as proof,"
                     f" case when r.n > 1 then sha256(array_to_string(r.ds[1:{slot}], '') || folded || array_to_string(r.ds[{slot} + 2:], '')) else folded end as folded"
                     f" from ({query}) q join {prefix}r{k} r on r.tree = q.at and r.run = q.place // {16 ** (k + 1)}")
        return query

    return f"""
with crc as materialized (select {table} as t),
docs as (select doc_id, coalesce('=' || source, '') as tree, {digest('text')} as leaf,
  case when {crc} % 5 = 0 then {digest(low)} else {digest('text')} end as shown from documents, crc),
placed as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from docs),
{up("a", "select tree, pos, n, leaf as digest from placed")},
subroots as materialized (select tree, digest as subroot, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as n from a{levels}),
{up("b", "select 0 as tree, pos, n, subroot as digest from subroots")},
inner_proof as ({climb("a", "select doc_id, tree as at, pos as place, leaf, '' as proof, shown as folded from placed")}),
outer_proof as ({climb("b", "select doc_id, leaf, subroot, 0 as at, s.pos as place, proof, folded from inner_proof i join subroots s on s.tree = i.at")})
select doc_id, leaf, subroot, b.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = b.digest as verified
from outer_proof, b{levels} b"""


@query("op11_merkle_manifest", _merkle_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(_table(spark, folder, "documents")).drop("steps")


@query("op12_suffix_array_dedup", """
with d as materialized (select row_number() over () as r, coalesce(doc_id, -9223372036854775808) as place, doc_id,
    hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as materialized (select r, place, s, md5_number(substr(h, 2 * s + 1, 200)) as k
  from (select r, place, h, unnest(range(0, n - 99)) as s from d where n >= 100)),
firsts as (select k, min(struct_pack(place, s)) as f from w group by k having count(*) > 1),
late as (select r, s from w join firsts using (k) where struct_pack(place, s) > f),
cut as (select r, s, sum(new) over (partition by r order by s) as run
  from (select r, s, (s > coalesce(lag(s) over (partition by r order by s) + 100, -1))::int as new from late)),
runs as (select r, run, min(s) as a, max(s) + 100 as b from cut group by r, run),
gaps as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as done from runs),
kept as (select r, count(*) as n_spans, sum(b - a)::bigint as n_removed,
    string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as rest
  from gaps join d using (r) group by r)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(rest, h))) as kept_sha256 from d left join kept using (r)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_repeats.remove_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(_table(spark, folder, "conversations"), damage=True)[0]


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
