"""The queries of this subpackage over the whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, importance, licenses, lines, minhash, pieces, substrings, suffix_tree, topk
from tessera.llm._shared import keep, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted, then read back from the formatted text."""
    import hashlib

    told = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], turns.schema)

    def digest(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for conv, text, runs in zip(df["conv_id"], df["formatted"], df["loss_runs"], strict=True):
                back, loss = chat.read_back(text), chat.masked_text(text, runs)
                whole = "".join(f"{r}\n{t}\n" for r, t in back).encode()
                out.append((conv, len(back), hashlib.sha256(whole).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chat.format_chats(turns.unionByName(more)).mapInPandas(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


ORACLE_SQL["op1_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(8 + length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '</turn>', '</turn'))) 
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + case when before is null or before != role then 6 + length(role) else 0 end) as bigint) as formatted_chars
from e group by conv_id
"""


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


ORACLE_SQL["op7_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id != c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each document states."""
    found = licenses.recognise(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_sentences",
        F.size(F.filter("sentence_ids", lambda i: i > 0)).cast("long").alias("n_known"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches")), ",").alias("licenses"),
    )


def _license_sql() -> str:
    ids, rules = licenses.known()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    all_known = ", ".join(quoted(s) for s in ids)
    marks = "'<' || array_to_string(ids, '><') || '>'"
    for licence, rule in rules:
        if len(rule) > 1:
            marks = f"regexp_replace({marks}, '{licenses.rule_pattern(rule)}', '[{licence}]', 'g')"
    alone = ", ".join("null" if x is None else quoted(x) for x in licenses.single_sentence(rules)[1:])

    def normal(text: str, ends: str) -> str:
        cut = f"regexp_replace({text}, {quoted(ends)}, '\\1' || chr(10), 'g')"
        plain = f"trim(translate(regexp_replace({cut}, '[^A-Za-z0-9\\n]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
        return f"list_filter(list_transform(regexp_split_to_array({plain}, ' ?\\n[ \\n]*'), lambda x: trim(x)), lambda x: x != '')"

    bare = f"regexp_replace(replace(replace(coalesce(text, ''), '{licenses.TAG}:', '{licenses.TAG}'), chr(13), ''), {quoted(licenses._COMMENT)}, '\\1', 'g')"
    joined = f"replace(regexp_replace({bare}, '\\n{{2,}}', '.' || chr(9), 'g'), chr(10), ' ')"
    paragraphs = normal(joined, r"""([.!?;:])["')]*[ \t]+""")
    return rf"""
with s as (
  select doc_id, {normal(f"replace(coalesce(text, ''), '{licenses.TAG}:', '{licenses.TAG}')", r"([.!?;:])[ \t\r]+")} as s,
    list_filter({paragraphs}, lambda x: not regexp_matches(x, '{licenses._ENUMERATOR}')) as p from documents),
i as (
  select doc_id, len(s) as n_sentences,
    unnest([s, p]) as x, unnest([1, 2]) as way from s),
k as (select *, list_transform(x, lambda y: coalesce(list_position([{all_known}], regexp_replace(y, '{licenses.STATED}', 'licensed under ')), 0)) as ids from i),
m as (select *, regexp_extract_all({marks}, '\[[^\]]+\]|<[0-9]+>', 0) as found from k),
f as (
  select *, list_filter(list_transform(found, lambda t: case when t[1] = '[' then t[2:-2] else [{alone}][cast(t[2:-2] as integer)] end), lambda t: t is not null) as named from m)
select doc_id, any_value(n_sentences) as n_sentences, sum(case when way = 1 then len(list_filter(ids, lambda x: x > 0)) else 0 end)::bigint as n_known,
  len(list_distinct(flatten(list(named)))) as n_matches, array_to_string(list_sort(list_distinct(flatten(list(named)))), ',') as licenses
from f group by doc_id
"""


ORACLE_SQL["op8_license_scan"] = _license_sql()


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that other documents keep."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Lower-cases A-Z only.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op3_line_dedup"] = rf"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
s as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, s.keeper is not null and s.keeper != doc_id as gone from k left join s using (key))
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of benchmark items."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op5_benchmark_decontamination"] = rf"""
with d as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
b as (select item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from benchmark),
bw as (
  select item_id, n, array_to_string(w[i + 1 : i + n], ' ') as g
  from (select *, least(len(w), 10) as n, unnest(range(len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as g
  from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
m as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw using (n, g)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
x as (
  select doc_id, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join x using (doc_id)
"""


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of similarity 0.75 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL["op2_minhash_near_dedup"] = rf"""
with recursive d as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') as g
  from (select *, unnest(range(greatest(len(w) - 4, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by 1, 2),
links as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
reach(id, node) as (select a, b from links union select r.id, l.b from reach r join links l on r.node = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least(d.doc_id, m.least_id), d.doc_id) as component_id,
  d.doc_id = coalesce(least(d.doc_id, m.least_id), d.doc_id) as kept
from d left join n using (doc_id) left join (select id as doc_id, min(node) as least_id from reach group by id) m using (doc_id)
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of passages of 50 words that smaller documents hold."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL["op10_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) as h
  from (select *, unnest(range(len(w) - 49)) as i from d where len(w) >= 50)),
f as (select h, min(doc_id) as least_id from g group by h),
x as (select distinct doc_id, unnest(range(i, i + 50)) as p from g join f using (h) where doc_id > least_id),
t as (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from d),
k as (
  select t.doc_id, sum(case when x.p is null then 0 else 1 end) as n, string_agg(word, ' ' order by t.p) filter (where x.p is null) as s
  from t left join x on x.doc_id = t.doc_id and x.p = t.p group by t.doc_id)
select doc_id, len(w) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join k using (doc_id)
"""


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, classification and Gumbel top-k sample of half of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = importance.fit(docs, table(spark, sf_dir, "labels"))
    scored, _ = keep(importance.score_documents(docs, model, drop=("text",)), "scores")
    return importance.resample(scored, model)


@query
def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's own segmentation of each document (sample -1, without scores) and two sampled without
    replacement, with their pieces; all are decoded again."""
    docs = table(spark, sf_dir, "documents")
    found = pieces.sample_segmentations(docs, k=2, own=True).withColumnRenamed("key", "doc_id")
    return found.withColumn("n_pieces", F.size("pieces").cast("long"))


@query
def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of each document by token counts and by the suffix tree."""
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))
