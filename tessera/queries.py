"""Queries over the test tables, one for each operator, and their SQL for DuckDB.

The test tables stand in for a lake: ``orders`` and ``lineitem`` for metadata, ``documents`` for
payloads, and ``embeddings`` for atoms (21 points of each vector as the atoms of seven residues, the
last one a ligand).
"""

from __future__ import annotations



import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import checks, tables
from tessera.operators import geometry as g
from tessera.sources import pack
from tessera.sources.table_log import TableLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, for queries that write a table."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    shared = shared or tempfile.gettempdir()
    return f"{shared.rstrip('/').removeprefix('file://')}/tessera-{uuid.uuid4().hex}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered scan, projection and aggregation: orders of open status by priority."""
    orders = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderpriority", "o_totalprice")
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("select event_id, user_id, event_type from events")
def q01_scan_project(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


@_query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'P' and o_totalprice > 100000")
def q02_filter_project(spark, sf_dir):
    return _t(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_custkey", "o_totalprice")


_EXPECTED = "select distinct l_orderkey * 2 as o_orderkey from lineitem"


@_query(f"select e.o_orderkey, exists (select 1 from orders o where o.o_orderkey = e.o_orderkey) as found from ({_EXPECTED}) e")
def q03_check_exists(spark, sf_dir):
    expected = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey")).distinct()
    return checks.mark_existing(expected, _t(spark, sf_dir, "orders"), ["o_orderkey"])


@_query(" union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in ("orders", "lineitem", "events", "documents")))
def q04_row_count(spark, sf_dir):
    parts = [_t(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("orders", "lineitem", "events", "documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@_query("select l_orderkey, l_partkey, l_suppkey, l_quantity from lineitem where l_returnflag in ('A', 'R') and l_linenumber in (1, 2)")
def q05_index_cache(spark, sf_dir):
    return checks.project(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"], "l_quantity", {"l_returnflag": ["A", "R"], "l_linenumber": [1, 2]})


@_query("select p_partkey, p_name, p_brand from part where (p_name, p_brand) in (select (p_name, p_brand) from part group by p_name, p_brand having count(*) = 1)")
def q06_unique_row(spark, sf_dir):
    return checks.unique_rows(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"])


@_query("select n_nationkey, n_name, n_regionkey from nation")
def q07_time_travel(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    log = TableLog(spark, _scratch(spark))
    log.create(nation.schema)
    first = log.append(nation)
    log.append(nation)
    return log.read(first)


@_query(
    "select o_orderkey, o_custkey, o_totalprice, cast(null as double) as score from orders where o_orderkey % 2 = 0 "
    "union all select o_orderkey, cast(null as bigint), o_totalprice, o_totalprice * 2 from orders where o_orderkey % 2 = 1"
)
def q08_append_evolve(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    old = orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_totalprice")
    new = orders.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("score"))
    return tables.append_evolving(old, new)


@_query("select doc_id, sha256(text) as id_hex from documents")
def q09_content_id(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", names.content_id(F.col("text")).alias("id_hex"))


@_query(
    "with s as (select doc_id, octet_length(encode(text)) as len from documents), "
    "o as (select *, cast(coalesce(sum(47 + len) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as off from s) "
    "select doc_id, cast(len as integer) as len, off, off + 43 as data_off from o"
)
def q10_pack_offsets(spark, sf_dir):
    sizes = _t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("len"))
    return pack.offsets(sizes, "doc_id", "len")


@_query(
    "with k as (select distinct o_orderkey as k from orders), l as (select distinct l_orderkey as k from lineitem) "
    "select (select count(*) from k where k in (select k from l)) as n_found, (select count(*) from k where k not in (select k from l)) as n_missing"
)
def q11_check_complete(spark, sf_dir):
    expected = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    found, missing = checks.split_complete(expected, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])
    both = found.withColumn("hit", F.lit(1)).unionByName(missing.withColumn("hit", F.lit(0)))
    return both.agg(F.count_if(F.col("hit") == 1).alias("n_found"), F.count_if(F.col("hit") == 0).alias("n_missing"))


@_query("select distinct o_orderkey as k from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)")
def q12_missing_keys(spark, sf_dir):
    expected = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return checks.split_complete(expected, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])[1]


_FIRST = "select doc_id, text, row_number() over (partition by text order by doc_id) as nth from documents"


@_query(f"select doc_id, sha256(text) as id_hex from ({_FIRST}) where nth = 1")
def q13_dedupe_keep_first(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", names.content_id(F.col("text")).alias("id_hex"))
    return tables.keep_first(docs, "id_hex", ["doc_id"])


@_query(f"select doc_id, sha256(text) as id_hex from ({_FIRST}) where nth > 1")
def q13b_dedupe_ids(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", names.content_id(F.col("text")).alias("id_hex"))
    return tables.later_duplicates(docs, "id_hex", ["doc_id"])


@_query(f"select doc_id, sha256(text) as id_hex from documents where text not in (select text from ({_FIRST}) where nth > 1)")
def q13c_dedupe_compat(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", names.content_id(F.col("text")).alias("id_hex"))
    return tables.drop_listed(docs, tables.later_duplicates(docs, "id_hex", ["doc_id"]), "id_hex")


@_query("select o_orderkey, o_custkey, o_orderstatus from orders where not coalesce(o_orderstatus = 'P', false)")
def q14_delete_keys(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.delete_where(orders, checks.equals({"o_orderstatus": "P"}))


@_query("select '>' || concat_ws('_', cast(doc_id as varchar), lang) || chr(10) || text as record from documents where text is not null")
def q15_fasta(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").filter("text is not null")
    return docs.select(names.fasta_record(names.joined_name(["doc_id", "lang"]), F.col("text")).alias("record"))


@_query("select doc_id, concat_ws('_', source, lang, cast(doc_id as varchar)) || '.cif' as file_name from documents")
def q16_export_name(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", names.with_suffix(names.joined_name(["source", "lang", "doc_id"])).alias("file_name"))


@_query("select user_id, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from events group by user_id")
def q17_group_runs(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@_query("select l_orderkey, l_linenumber, l_partkey, p_name, p_brand from lineitem join part on l_partkey = p_partkey where p_size < 25")
def q18_design_join(spark, sf_dir):
    from tessera.plans.analysis import join_designs

    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    designs = _t(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), F.struct("p_name", "p_brand").alias("design_id"))
    return join_designs(lines, designs, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "design_id.p_name", "design_id.p_brand")


@_query(
    "with s as (select l_orderkey, count(*) as n_lines, round(sum(l_quantity), 2) as o_totalprice from lineitem where l_returnflag = 'R' group by l_orderkey) "
    "select o_orderkey, o_custkey, case when s.l_orderkey is not null then s.o_totalprice else o.o_totalprice end as o_totalprice, n_lines "
    "from orders o left join s on s.l_orderkey = o.o_orderkey"
)
def q19_merge_update(spark, sf_dir):
    source = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    source = source.agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("o_totalprice"))
    return tables.merge_update(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), source, "o_orderkey")


@_query("select (select count(*) from orders) as n_main, (select count(*) from lineitem) as n_staging, (select count(*) from orders) = (select count(*) from lineitem) as same")
def q19b_count_guard(spark, sf_dir):
    both = _t(spark, sf_dir, "orders").select(F.lit(0).alias("s")).union(_t(spark, sf_dir, "lineitem").select(F.lit(1)))
    n = both.agg(F.count_if(F.col("s") == 0).alias("n_main"), F.count_if(F.col("s") == 1).alias("n_staging"))
    return n.withColumn("same", F.col("n_main") == F.col("n_staging"))


_TYPES = ("click", "view", "purchase")


@_query(
    "select user_id, " + ", ".join(f"round(avg(value) filter (where event_type = '{t}'), 6) as mean_{t}" for t in _TYPES) + " from events group by user_id"
)
def q20_pivot_means(spark, sf_dir):
    from tessera.plans.analysis import ligand_plddt

    atoms = _t(spark, sf_dir, "events").select(F.col("user_id").alias("pair_id"), F.lit(True).alias("hetero"), F.col("event_type").alias("res_name"), F.col("value").alias("b_factor"))
    wide = ligand_plddt(atoms, _TYPES)
    return wide.select(F.col("pair_id").alias("user_id"), *[F.round(f"pLDDT_LIG_{t}", 6).alias(f"mean_{t}") for t in _TYPES])


@_query("select user_id, round(avg(value), 6) as mean_all, round(avg(value) filter (where event_type = 'click'), 6) as mean_masked from events group by user_id")
def q21_masked_mean(spark, sf_dir):
    masked = F.avg(F.when(F.col("event_type") == "click", F.col("value")))
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean_all"), F.round(masked, 6).alias("mean_masked"))


def atoms_of(vectors: DataFrame) -> DataFrame:
    """Vectors as structures: point i is an atom of residue i div 3; residues 0 to 5 are amino acids."""
    points = vectors.select(F.col("vec_id").alias("struct_id"), "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("atom_idx"))
    res = F.floor(F.col("atom_idx") / 3).cast("int")
    kinds = F.array(*map(F.lit, _KINDS))
    at = F.col("atom_idx") % 3
    name = F.when(res == 6, F.lit("LIG")).otherwise(F.get(kinds, (res + F.col("label")) % 6))
    return points.select(
        "struct_id",
        "atom_idx",
        F.when(res == 6, "B").otherwise("A").alias("chain_id"),
        res.alias("res_id"),
        name.alias("res_name"),
        (res == 6).alias("hetero"),
        F.when(res == 6, F.concat(F.lit("C"), (at + 1).cast("string")))
        .when(at == 0, "CA")
        .otherwise(F.concat(F.when(name == "VAL", "CG").otherwise("CD"), at.cast("string")))
        .alias("atom_name"),
        *[F.get("embedding", F.col("atom_idx") * 3 + i).cast("double").alias(c) for i, c in enumerate("xyz")],
    )


# Residue names of the structures made from vectors.
_KINDS = ["LEU", "ALA", "VAL", "GLY", "LEU", "SER"]
_ATOMS = """
p as (select vec_id as struct_id, label, embedding as e, unnest(range(21)) as i from embeddings),
r as (select *, cast(i // 3 as integer) as res_id, case when i // 3 = 6 then 'LIG' else list_extract(['LEU', 'ALA', 'VAL', 'GLY', 'LEU', 'SER'], 1 + (i // 3 + label) % 6) end as res_name from p),
atoms as (
  select struct_id, cast(i as integer) as atom_idx, case when res_id = 6 then 'B' else 'A' end as chain_id, res_id, res_name, res_id = 6 as hetero,
    case when res_id = 6 then 'C' || (i % 3 + 1) when i % 3 = 0 then 'CA' else case when res_name = 'VAL' then 'CG' else 'CD' end || (i % 3) end as atom_name,
    cast(e[3 * i + 1] as double) as x, cast(e[3 * i + 2] as double) as y, cast(e[3 * i + 3] as double) as z from r)"""
# Each structure and the next one of its label.
_PAIRS = """,
nexts as (select vec_id as fixed_id, lead(vec_id) over (partition by label order by vec_id) as mobile_id from embeddings),
pairs as (
  select fixed_id as pair_id, a.*, b.x as mx, b.y as my, b.z as mz, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 as d
  from nexts join atoms a on a.struct_id = fixed_id join atoms b on b.struct_id = mobile_id and b.atom_idx = a.atom_idx)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    vectors = _t(spark, sf_dir, "embeddings")
    after = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    nexts = vectors.select(F.col("vec_id").alias("pair_id"), F.col("vec_id").alias("fixed_id"), after.alias("mobile_id")).filter("mobile_id is not null")
    atoms = atoms_of(vectors)
    return g.pair_atoms(atoms, atoms, nexts)


@_query(f"with {_ATOMS}{_PAIRS} select pair_id, round(sqrt(avg(d)), 6) as rmsd_all, round(sqrt(avg(d) filter (where atom_name = 'CA' and not hetero)), 6) as rmsd_ca from pairs group by pair_id")
def q22_rmsd(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    ca = (F.col("atom_name") == "CA") & ~F.col("hetero")
    both = g.rmsd(pairs, name="rmsd_all").join(g.rmsd(pairs, ca, "rmsd_ca"), "pair_id")
    return both.select("pair_id", *[F.round(c, 6).alias(c) for c in ("rmsd_all", "rmsd_ca")])


@_query()
def q23_superpose(spark, sf_dir):
    fitted = g.superpose(_pairs(spark, sf_dir), (F.col("atom_name") == "CA") & ~F.col("hetero"))
    return g.rmsd(fitted, name="rmsd").select("pair_id", F.round("rmsd", 5).alias("rmsd"))


@_query(f"with {_ATOMS} select distinct struct_id as pair_id, cast(0 as double) as rmsd from atoms")
def q23b_superpose_moved(spark, sf_dir):
    """Each structure on a copy turned by a right angle and shifted: they coincide."""
    atoms = atoms_of(_t(spark, sf_dir, "embeddings")).withColumnRenamed("struct_id", "pair_id")
    pairs = atoms.select("*", (F.col("y") + 2).alias("mx"), (3 - F.col("x")).alias("my"), (F.col("z") - 1).alias("mz"))
    fitted = g.superpose(pairs, (F.col("atom_name") == "CA") & ~F.col("hetero"))
    return g.rmsd(fitted, name="rmsd").select("pair_id", F.round("rmsd", 6).alias("rmsd"))


@_query(
    f"with {_ATOMS}{_PAIRS}, o as (select p.*, q.mx as ox, q.my as oy, q.mz as oz from pairs p left join pairs q on p.pair_id = q.pair_id and p.res_id = q.res_id "
    "and p.res_name in ('LEU', 'VAL') and p.atom_idx % 3 != 0 and q.atom_idx % 3 = 3 - p.atom_idx % 3), "
    "s as (select pair_id, res_id, sum(d) as d, sum((x - coalesce(ox, mx)) ** 2 + (y - coalesce(oy, my)) ** 2 + (z - coalesce(oz, mz)) ** 2) as w, count(*) as n from o group by 1, 2) "
    "select pair_id, round(sqrt(sum(least(d, w)) / sum(n)), 6) as rmsd from s group by pair_id"
)
def q24_automorphic(spark, sf_dir):
    return g.automorphic_rmsd(_pairs(spark, sf_dir)).select("pair_id", F.round("rmsd", 6).alias("rmsd"))


_RADIUS = 0.12
_NEAR = f"near_ as (select distinct a.struct_id, a.atom_idx, a.chain_id, a.res_id from atoms a join atoms h on h.struct_id = a.struct_id and h.hetero and not a.hetero and (a.x - h.x) ** 2 + (a.y - h.y) ** 2 + (a.z - h.z) ** 2 <= {_RADIUS} * {_RADIUS})"


@_query(f"with {_ATOMS}, {_NEAR} select struct_id, atom_idx from near_")
def q25_neighbours(spark, sf_dir):
    return g.near_hetero(atoms_of(_t(spark, sf_dir, "embeddings")), _RADIUS).select("struct_id", "atom_idx")


@_query(f"with {_ATOMS}, {_NEAR} select struct_id, atom_idx, atom_name from atoms where (struct_id, chain_id, res_id) in (select (struct_id, chain_id, res_id) from near_)")
def q26_expand_mask(spark, sf_dir):
    atoms = atoms_of(_t(spark, sf_dir, "embeddings"))
    return g.expand_to_residues(atoms, g.near_hetero(atoms, _RADIUS)).select("struct_id", "atom_idx", "atom_name")


# The next structure of a label has the same residues; the one by id has others.
_OTHER = "other as (select a.* exclude (struct_id), a.struct_id - 1 as struct_id from atoms a)"


def _other(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("struct_id", F.col("struct_id") - 1)


@_query(
    f"with {_ATOMS}, {_OTHER}, n1 as (select struct_id, res_id, min_by(res_name, atom_idx) as n from atoms group by 1, 2), n2 as (select struct_id, res_id, min_by(res_name, atom_idx) as n from other group by 1, 2) "
    "select struct_id, atom_idx from atoms join n1 using (struct_id, res_id) left join n2 using (struct_id, res_id) where atom_name in ('N', 'CA', 'C', 'O') or coalesce(n1.n = n2.n, false)"
)
def q27_common_residues(spark, sf_dir):
    atoms = atoms_of(_t(spark, sf_dir, "embeddings"))
    return g.common_residues(atoms, _other(atoms)).select("struct_id", "atom_idx")


@_query(
    f"with {_ATOMS}, {_OTHER} select o.struct_id, o.atom_idx from other o where exists (select 1 from atoms a where a.atom_idx >= 9 and a.struct_id = o.struct_id and a.chain_id = o.chain_id "
    "and a.res_id = o.res_id and a.atom_name = o.atom_name and (a.res_name = o.res_name or o.atom_name in ('N', 'CA', 'C', 'O')))"
)
def q28_translate_mask(spark, sf_dir):
    atoms = atoms_of(_t(spark, sf_dir, "embeddings"))
    return g.translate_mask(atoms.filter("atom_idx >= 9"), _other(atoms)).select("struct_id", "atom_idx")


@_query(
    f"with {_ATOMS} select a.struct_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) as distance from atoms a join atoms b using (struct_id) "
    "where a.res_name = 'LIG' and a.atom_name = 'C1' and b.res_name = 'VAL' and b.atom_name = 'CG1'"
)
def q29_atom_dist(spark, sf_dir):
    found = g.atom_distance(atoms_of(_t(spark, sf_dir, "embeddings")), ("LIG", "C1"), ("VAL", "CG1"))
    return found.select("struct_id", F.round("distance", 6).alias("distance"))


@_query(
    f"with {_ATOMS}, {_OTHER}, c as (select a.struct_id, a.res_name, a.res_id as ra, b.res_id as rb, sqrt(avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) as r "
    "from atoms a join other b on a.struct_id = b.struct_id and a.res_name = b.res_name and a.atom_name = b.atom_name group by 1, 2, 3, 4) "
    "select struct_id, res_name, round(min(r), 6) as rmsd from c group by 1, 2"
)
def q30_best_pair(spark, sf_dir):
    atoms = atoms_of(_t(spark, sf_dir, "embeddings"))
    return g.best_copies(atoms, _other(atoms)).select("struct_id", "res_name", F.round("rmsd", 6).alias("rmsd"))


_CONTIG = "concat('A', cast(c_nationkey + 1 as {0}), ',B', cast(c_nationkey + 2 as {0}), '-', cast(c_nationkey + 5 as {0}), ',', cast(c_nationkey + 1 as {0}))"


@_query(
    f"with c as (select c_custkey as id, unnest(string_split({_CONTIG.format('varchar')}, ',')) as p from customer), "
    "s as (select id, coalesce(nullif(regexp_extract(p, '^([A-Za-z])', 1), ''), 'A') as chain, cast(regexp_extract(p, '^[A-Za-z]?([0-9]+)', 1) as integer) as lo, "
    "cast(coalesce(nullif(regexp_extract(p, '-([0-9]+)$', 1), ''), regexp_extract(p, '^[A-Za-z]?([0-9]+)', 1)) as integer) as hi from c) "
    "select distinct id, chain, cast(unnest(range(lo, hi + 1)) as integer) as res from s"
)
def q31_contig(spark, sf_dir):
    specs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_CONTIG.format("string")).alias("contig"))
    return names.expand_contigs(specs)


@_query(
    "with p as (select p_partkey, array_to_string(string_split(p_name, ' ')[1:1], ' ') as key, p_retailprice as r from part), "
    "m as (select split_part(p_name, ' ', 1) as key, min(p_size) as motif from part group by 1) "
    "select p.key, motif, round(sqrt(avg(r * r)), 4) as overall from p join m using (key) group by 1, 2"
)
def q32_motif_map(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumn("key", names.first_parts(F.col("p_name"), 1, " "))
    maps = part.groupBy("key").agg(F.min("p_size").alias("motif"))
    r = F.col("p_retailprice")
    return part.join(maps, "key").groupBy("key", "motif").agg(F.round(F.sqrt(F.avg(r * r)), 4).alias("overall"))


@_query(
    "with a as (select p_partkey, case when p_brand = 'Brand#11' then 'Brand#12' else p_brand end as b, p_size < 25 as h from part) "
    "select p_partkey, case when b = 'Brand#12' then 'Brand#13' else b end as res_name, case when (case when b = 'Brand#12' then 'Brand#13' else b end) in ('Brand#13', 'Brand#21') then false else h end as hetero from a"
)
def q33_renames(spark, sf_dir):
    atoms = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("res_name"), (F.col("p_size") < 25).alias("hetero"))
    return names.as_polymer(names.rename_residues(atoms, ["Brand#11=Brand#12", "Brand#12=Brand#13"]), ["Brand#13", "Brand#21"])


@_query("select doc_id, n_chars = length(text) as ok from documents")
def q35_validate(spark, sf_dir):
    """Payloads are stored in packs, read back with their checksums, and measured."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", F.encode("text", "UTF-8").alias("data"))
    folder = _scratch(spark)

    def store(it):  # noqa: ANN001, ANN202
        import pyarrow as pa

        writer = pack.PackWriter(folder)
        for batch in it:
            out = [writer.append(d) for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.shard for a in out]), pa.array([a.data_off for a in out]), pa.array([a.len for a in out], pa.int32())],
                ["doc_id", "n_chars", "bcif_shard", "bcif_data_off", "bcif_len"],
            )
        writer.close()

    table = TableLog(spark, f"{folder}-table")
    schema = spark.createDataFrame([], "doc_id long, n_chars long, bcif_shard string, bcif_data_off long, bcif_len int").schema
    table.create(schema)
    table.append(docs.mapInArrow(store, schema))
    back = pack.fetch(table.read(), folder)
    return back.select("doc_id", (F.col("error").isNull() & (F.length(F.decode("payload", "UTF-8")) == F.col("n_chars"))).alias("ok"))


@_query("select event_id, json_extract_string(props, '$.k') as k from events")
def q36_heavy_json(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_query("select o_orderkey, o_custkey, o_orderstatus from orders")
def q38_optimize(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    log = TableLog(spark, _scratch(spark))
    log.create(orders.schema)
    log.append(orders.filter("o_orderkey % 2 = 0"))
    log.append(orders.filter("o_orderkey % 2 = 1"))
    log.rewrite("optimize", sorted(log.snapshot().files), tables.cluster(log.read(), "o_custkey", 4))
    log.vacuum()
    return log.read()


@_query("select event_id, user_id, event_type from events")
def q39_spool(spark, sf_dir):
    """Events through a stream that ends when all files are taken."""
    schema = _t(spark, sf_dir, "events").schema
    out = _scratch(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", "user_id", "event_type")
    log = TableLog(spark, f"{out}/table")
    log.create(stream.schema)

    def store(df: DataFrame, epoch: int) -> None:
        log.append(df)

    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return log.read()
