"""Stages, sources and audits on small tables."""

import json
import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillon as q
from quillon.functions import correction
from quillon.operators import cells, cluster, codes, ingest, mapping, normalize, ward, weights
from quillon.operators.mapping import check_mapping

CONDITIONS = {"ctl": ("S1", "S2", "S3"), "trt": ("S4", "S5", "S6")}


def config(**more):
    return q.Config(control_condition="ctl", conditions=CONDITIONS, input_is_log2=True, **({"fdr": 0.05} | more))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for protein in ("P1", "P2"):
        for pep in range(4):
            for s in range(6):
                shift = 4 if (protein, pep) == ("P1", 0) and s >= 3 else 0
                out.append((protein, f"PEP{pep}", f"S{s + 1}", float(10 + pep + shift + 0.05 * rng.standard_normal())))
    return out


@pytest.fixture(scope="module")
def peptides(spark, rows):
    return spark.createDataFrame(rows, "protein_id string, peptide_id string, sample_id string, intensity double")


@pytest.mark.parametrize("model", ["wls", "rlm"])
def test_end_to_end(spark, peptides, model):
    source = peptides.withColumn("weight", F.lit(1.0)) if model == "wls" else peptides
    data = q.prepare(source, config(model=model))
    found = q.run_discordance(data)
    got = {(r.protein_id, r.peptide_id): r for r in found.table.collect()}
    assert len(got) == 8 and got["P1", "PEP0"].is_discordant and min(got, key=lambda k: got[k].raw_p_value) == ("P1", "PEP0")
    assert found.metadata["n_tested"] == 8 and found.n_discordant == found.discordant.count()
    clusters = q.run_cluster(data, found)
    mapped = q.assign_proteoforms(data, found, clusters)
    assert mapped.table.count() == 8 and mapped.table.where("is_discordant and dpf_id = 0").isEmpty()
    assert data.n_proteins == 2 and data.n_peptides == 8 and data.n_samples == 6


def test_control_means_are_zero_and_long_equals_wide(spark, peptides, rows):
    got = q.prepare(peptides, config()).peptides
    means = got.where("condition = 'ctl'").groupBy("protein_id", "peptide_id").agg(F.avg("intensity_normalized").alias("m")).collect()
    assert max(abs(r.m) for r in means) < 1e-12
    wide = np.array([r[3] for r in rows]).reshape(8, 6)
    want = normalize.normalize_control_relative(wide, [0, 1, 2], True)
    have = {(r.protein_id, r.peptide_id, r.sample_id): r.intensity_normalized for r in got.collect()}
    assert np.allclose([have[r[:3]] for r in rows], want.ravel(), atol=1e-10)


def test_wls_agrees_with_a_dense_model(spark, peptides):
    from quillon.functions.tails import wald_pvalue

    data = peptides.withColumn("weight", F.when(F.col("sample_id").isin("S2", "S5"), 0.5).otherwise(1.0))
    prepared = q.prepare(data, config(model="wls"))
    have = {(r.protein_id, r.peptide_id): r.raw_p_value for r in cells.wls_pvalues(prepared.peptides, F.col("weight"), 2).collect()}
    frame = prepared.peptides.orderBy("protein_id", "peptide_id", "sample_id").toPandas()
    for (protein, pep), p in have.items():
        x = frame[frame.protein_id == protein]
        own, treated, w, y = ((x.peptide_id == pep).to_numpy(float), (x.condition == "trt").to_numpy(float), x.weight.to_numpy(), x.intensity_normalized.to_numpy())
        m = np.stack([np.ones(len(x)), treated, own, own * treated], 1)
        normal = (m.T * w) @ m
        beta = np.linalg.solve(normal, (m.T * w) @ y)
        df = len(x) - 4
        cov = np.linalg.inv(normal) * (w @ (y - m @ beta) ** 2) / df
        assert p == pytest.approx(wald_pvalue(beta[3:], cov[3:, 3:], True, df), rel=1e-8)


def test_fit_statuses(spark):
    schema = "protein_id string, peptide_id string, condition string, intensity_normalized double"
    rows = [("A", f"p{i}", c, float(i)) for i in range(2) for c in ("x", "y") for _ in range(2)]
    assert {r.fit_status for r in cells.wls_pvalues(spark.createDataFrame(rows, schema), F.lit(1.0), 2).collect()} == {"zero_scale"}
    few = [("A", f"p{i}", c, 1.0) for i in range(2) for c in ("x", "y")]
    assert {r.fit_status for r in cells.wls_pvalues(spark.createDataFrame(few, schema), F.lit(1.0), 2).collect()} == {"insufficient_df"}
    rng = np.random.default_rng(0)
    gap = [("A", f"p{i}", c, float(rng.uniform())) for i in range(3) for c in ("x", "y") for _ in range(3) if (i, c) != (0, "y")]
    got = {r.peptide_id: r.fit_status for r in cells.wls_pvalues(spark.createDataFrame(gap, schema), F.lit(1.0), 2).collect()}
    assert got == {"p0": "ill_conditioned", "p1": "ok", "p2": "ok"}


@pytest.mark.parametrize("method", ["bonferroni", "holm", "hochberg", "fdr_bh", "BY", "hommel", "qvalue", None])
def test_table_correction_is_vector_correction(spark, method):
    rng = np.random.default_rng(11)
    p = np.concatenate([np.round(rng.uniform(size=300), 2), rng.beta(0.2, 3, 100), [1.0] * 50])
    rows = [(i, f"g{i % 7}", float(x)) for i, x in enumerate(p)] + [(1000, "g0", None), (1001, "g1", float("nan"))]
    df = spark.createDataFrame(rows, "i int, g string, p double")
    got = {r.i: r.a for r in correction.adjust(df, method, "p", "a").collect()}
    assert len(got) == len(rows) and got[1000] is None and got[1001] is None
    assert np.allclose([got[i] for i in range(len(p))], correction.p_adjust(p, method), atol=1e-9)
    inside = {r.i: r.a for r in correction.adjust_within(df, method, "g", "p", "a").collect()}
    want = correction.p_adjust_by_group(p, [r[1] for r in rows[: len(p)]], method)
    assert np.allclose([inside[i] for i in range(len(p))], want, atol=1e-9) and inside[1001] is None


@pytest.mark.parametrize("method", ["holm", "fdr_bh", "hommel", "qvalue"])
def test_many_ranges_and_heavy_values(spark, monkeypatch, method):
    """Small ranges, a third of all p-values equal to 1, and more tests than values."""
    monkeypatch.setattr(correction, "RANGE_VALUES", 40)
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.beta(0.3, 2, 500), np.round(rng.uniform(size=100), 1), [1.0] * 300])
    df = spark.createDataFrame([(i, float(x), 1, 2) for i, x in enumerate(p)], "i int, p double, c int, a int")
    for n_tests in (None, 2000):
        got = {r.i: r.out for r in correction.adjust(df, method, "p", "out", n_tests).collect()}
        assert np.allclose([got[i] for i in range(len(p))], correction.p_adjust(p, method, n_tests), atol=1e-12)
    assert correction.adjust(df, method, "p", "out").columns == ["i", "p", "c", "a", "out"]
    assert correction.release() > 0 and correction.release() == 0


@pytest.mark.parametrize("method", ["BY", "fdr_bh", "hochberg", "holm", "hommel", "qvalue"])
def test_p_values_that_differ_between_runs(spark, method):
    """Sums of floating-point numbers differ in their last bits from run to run: every row has its corrected value all the same."""
    noise = F.udf(lambda p: p * (1 + int.from_bytes(os.urandom(1), "big") * 2.0**-52), "double").asNondeterministic()
    p = np.random.default_rng(2).beta(0.3, 2, 200)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double").select("i", noise("p").alias("p"), F.lit(None).alias("void"))
    out = correction.adjust(df, method, "p", "a")
    got = {r.i: r.a for r in out.collect()}
    assert out.columns == ["i", "p", "void", "a"] and None not in got.values()
    assert np.allclose([got[i] for i in range(len(p))], correction.p_adjust(p, method), rtol=1e-9)


def test_harmonic_sum_of_many(spark):
    n = 5000
    got = spark.range(1).select(correction.harmonic(F.lit(n).cast("long")).alias("h")).first().h
    assert got == pytest.approx(np.sum(1 / np.arange(1, n + 1)), rel=1e-14)


def test_group_numbers(spark):
    rows = [("P", 1, False), ("P", 1, True), ("P", 2, True), ("P", 3, False), ("P", 4, True), ("P", 4, True)]
    got = {r.cluster_id: r.dpf_id for r in mapping.group_numbers(spark.createDataFrame(rows, "protein_id string, cluster_id long, is_discordant boolean")).collect()}
    assert got == {1: 1, 2: -1, 3: 0, 4: 2}
    bad = spark.createDataFrame([("P", "a", True, 1, 0)], "protein_id string, peptide_id string, is_discordant boolean, cluster_id long, dpf_id long")
    with pytest.raises(q.ContractError):
        check_mapping(bad)


def test_codes(spark):
    df = spark.createDataFrame([(f"P{i:03d}", p) for i in range(150) for p in ("b", "a")], "protein_id string, peptide_id string")
    assert [r.protein_index for r in codes.protein_ordinal(df).orderBy("protein_id").collect()] == list(range(150))
    assert {(r.peptide_id, r.peptide_code) for r in codes.peptide_codes(df).collect()} == {("a", 0), ("b", 1)}


def test_representative_accession(spark):
    df = spark.createDataFrame([("A0A075B6K5;Q12345",), ("LONGNAME;OTHER",), ("P11111",), (None,)], "g string")
    assert [r.a for r in df.select(ingest.representative(F.col("g")).alias("a")).collect()] == ["Q12345", "LONGNAME", "P11111", None]


def test_profiles_fill_missing_conditions(spark):
    df = spark.createDataFrame([("P", "a", "x", 1.0), ("P", "a", "x", 3.0), ("P", "b", "y", 4.0)], "protein_id string, peptide_id string, condition string, intensity_normalized double")
    got = {r.peptide_id: list(r.profile) for r in cluster.profiles(df, ("x", "y")).collect()}
    assert got == {"a": [2.0, 0.0], "b": [0.0, 4.0]}


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_clusters_of_proteins_that_batches_cut(spark, batch):
    """Small batches and one give the kernel's labels, also for a null name, single peptides and a protein of many batches."""
    rng = np.random.default_rng(9)
    sizes = {"A": 1, "B": 2, "C": 11, "D": 4, None: 5, "E": 1, "F": 3}
    x = {k: rng.normal(size=(n, 3)) for k, n in sizes.items()}
    rows = [(k, f"p{i:02d}", x[k][i].tolist()) for k in x for i in range(len(x[k]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        table = spark.createDataFrame(rows[::-1], "protein_id string, peptide_id string, profile array<double>").coalesce(1)
        got = cluster.cluster_table(table, config()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(k, f"p{i:02d}"): int(c) for k in x for i, c in enumerate(ward.cluster_profiles(x[k], config()))}
    assert len(got) == len(want) and {(r.protein_id, r.peptide_id): r.cluster_id for r in got} == want


def broken(rows, kind):
    if kind == "duplicate":
        return [*rows, rows[0]]
    if kind == "nan":
        return [(*rows[0][:3], float("nan")), *rows[1:]]
    if kind == "few":
        return [r for r in rows if r[:2] not in (("P1", "PEP1"), ("P1", "PEP2"))]
    return [r for r in rows if r[2] != "S6"]


@pytest.mark.parametrize("kind", ["duplicate", "nan", "few", "sample"])
def test_broken_tables_raise(spark, rows, kind):
    df = spark.createDataFrame(broken(rows, kind), "protein_id string, peptide_id string, sample_id string, intensity double")
    with pytest.raises(q.ContractError):
        q.prepare(df, config())


def test_other_contract_breaks(spark, peptides):
    with pytest.raises(q.ContractError):
        q.prepare(peptides.drop("intensity"), config())
    with pytest.raises(q.ContractError):
        q.prepare(peptides, config(model="wls"))
    with pytest.raises(q.ContractError):
        q.prepare(peptides.withColumn("intensity", -F.col("intensity")), config().replace(input_is_log2=False))
    with pytest.raises(q.ContractError):
        q.prepare(peptides.withColumn("intensity", F.lit(3.0)), config())
    with pytest.warns(q.ScopeWarning):
        q.prepare(peptides.unionByName(peptides.withColumn("sample_id", F.lit("S9")).dropDuplicates(["protein_id", "peptide_id"])), config())


def test_provenance(spark, peptides):
    masks = peptides.select("protein_id", "peptide_id", "sample_id", F.lit(True).alias("is_real"), F.lit(False).alias("is_complete_missing"))
    got = q.prepare(peptides, config(model="wls"), provenance=masks)
    assert "is_real" in got.peptides.columns
    with pytest.raises(q.ContractError):
        weights.attach_provenance(peptides, masks.where("sample_id <> 'S1'"))
    with pytest.raises(q.ContractError):
        weights.attach_provenance(peptides.where("sample_id <> 'S1'"), masks)
    with pytest.raises(q.ContractError):
        q.provenance_from_frame(peptides)
    with pytest.raises(q.ContractError):
        weights.imputation_weights(F.lit(True), F.lit(True), 1.0)


def test_prepare_runs_its_source_once(spark, peptides):
    """The audits and the normalization's statistics come from one run of the source, the result from one more."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    n = peptides.count()
    source = peptides.mapInArrow(count, peptides.schema)
    data = q.prepare(source, config())
    assert seen.value == n and data.metadata["finite"]
    raw = q.select_model("rlm")(data)
    assert seen.value == n
    raw.collect()
    assert seen.value == 2 * n
    q.run_discordance(data).table.collect()
    assert seen.value <= 4 * n


def test_stages_run_source_and_clusters_once(spark, peptides):
    """Audits and statistics run the source once, all stages together once more; profiles are clustered once."""
    seen = {k: spark.sparkContext.accumulator(0) for k in ("source", "profiles")}

    def counted(df, counter):
        def count(batches):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema)

    n = peptides.count()
    data = q.prepare(counted(peptides, seen["source"]), config())
    found = q.run_discordance(data)
    clusters = q.run_cluster(data, found, builder=lambda prepared, _: counted(cluster.profiles(prepared.peptides, ("ctl", "trt")), seen["profiles"]))
    assert len(q.assign_proteoforms(data, found, clusters, check=False).table.collect()) == 8
    assert seen["source"].value == 2 * n and seen["profiles"].value == 8


def test_numbers_of_peptides_without_clusters(spark):
    keys = "protein_id string, peptide_id string"
    rows = [("P", "a", True, None), ("P", "b", True, None), ("P", "c", True, 2), ("P", "d", False, 2), ("P", "e", True, 3), ("Q", "a", False, 1), (None, "a", True, None)]
    peptides = spark.createDataFrame([r[:2] for r in rows], keys)
    flags = spark.createDataFrame([r[:3] for r in rows], f"{keys}, is_discordant boolean")
    clusters = spark.createDataFrame([(*r[:2], r[3]) for r in rows if r[3]], f"{keys}, cluster_id long")
    got = {r[:2]: r[2:] for r in map(tuple, mapping.map_peptides(peptides, flags, clusters).collect())}
    assert got == {("P", "a"): (True, None, 0), ("P", "b"): (True, None, 0), ("P", "c"): (True, 2, 1), ("P", "d"): (False, 2, 1), ("P", "e"): (True, 3, -1), ("Q", "a"): (False, 1, 0), (None, "a"): (False, None, 0)}


def test_peptides_without_control_rows(spark, peptides):
    """Their normalized values are null: the tests refuse them, as they do without the audits."""
    bare = peptides.where("not (peptide_id = 'PEP1' and sample_id in ('S1', 'S2', 'S3'))")
    for check in (True, False):
        data = q.prepare(bare, config(), check=check)
        assert not data.metadata.get("finite")
        with pytest.raises(q.ContractError):
            q.run_discordance(data)
    with pytest.raises(q.ContractError):
        q.prepare(peptides.withColumn("intensity", F.lit(True)), config())


def test_profiles_of_ones_own(spark, peptides):
    data = q.prepare(peptides, config(cut="fixed_height", fixed_n_clusters=2))
    halves = lambda prepared, _: prepared.peptides.select("protein_id", "peptide_id").distinct().withColumn("profile", F.array((F.col("peptide_id") > "PEP1").cast("double")))
    got = q.run_cluster(data, q.run_discordance(data), builder=halves).table.collect()
    assert len({(r.protein_id, r.cluster_id, r.peptide_id > "PEP1") for r in got}) == 4


def test_files(spark, peptides, tmp_path):
    cfg = config(column_map=q.ColumnMap(protein_id="prot", peptide_id="pep", sample_id="run", intensity="quant"))
    raw = peptides.toDF("prot", "pep", "run", "quant").withColumn("more", F.lit("x"))
    frame = raw.toPandas()
    frame.to_csv(tmp_path / "a.csv", index=False)
    frame.to_csv(tmp_path / "a.tsv", index=False, sep="\t")
    frame.to_parquet(tmp_path / "a.parquet")
    want = sorted(map(tuple, peptides.collect()))
    for name in ("a.csv", "a.tsv", "a.parquet"):
        got = q.read_peptides(spark, str(tmp_path / name), cfg)
        assert got.columns == ["protein_id", "peptide_id", "sample_id", "intensity"] and sorted(map(tuple, got.collect())) == want
    assert q.prepare_from_parquet(spark, str(tmp_path / "a.parquet"), cfg).n_peptides == 8
    for bad in ("a.xlsx", "none.csv", "none.parquet"):
        with pytest.raises(q.SourceError):
            q.read_peptides(spark, str(tmp_path / bad), cfg).count()
    (tmp_path / "d.csv").write_text("sample_id,condition\nS1,a\nS2,b\n")
    assert q.read_design(spark, str(tmp_path / "d.csv")).condition_to_samples == {"a": ("S1",), "b": ("S2",)}
    (tmp_path / "d.csv").write_text("sample_id,condition\nS1,a\nS1,b\n")
    with pytest.raises(q.ContractError):
        q.read_design(spark, str(tmp_path / "d.csv"))
    (tmp_path / "config.yaml").write_text(cfg.to_yaml())
    (tmp_path / "manifest.yaml").write_text("name: x\nfiles: {peptides: a.csv, config: config.yaml}\n")
    bundle = q.load_fixture_bundle(tmp_path / "manifest.yaml")
    assert bundle.load_config() == cfg and bundle.files["peptides"].name == "a.csv"
    (tmp_path / "manifest.yaml").write_text("name: x\nfiles: {peptides: gone.csv, config: config.yaml}\n")
    with pytest.raises(q.SourceError):
        q.load_fixture_bundle(tmp_path / "manifest.yaml")


def test_filter_and_columns_reach_the_scan(spark, peptides, tmp_path):
    peptides.withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "t.parquet"))
    plan = q.read_peptides(spark, str(tmp_path / "t.parquet"), config())._jdf.queryExecution().executedPlan().toString()
    assert "In(sample_id" in plan and "more" not in plan


FASTA = """>sp|P11111|AAA1_X First protein OS=Homo sapiens OX=9606 GN=AAA1 PE=1 SV=2
acdefghik

LMN
>tr|Q22222-2|BBB2_X Second|piece OS=Mus musculus OX=10090 PE=x SV=1
ACDEFGHBZ
>no bars here
ACDEFGHIK
>sp|P33333|CCC_X Short OS=X GN=G
ACD
>sp|P44444|DDD_X Bad GN=D
ACDEF1HIK
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("﻿" + FASTA.replace("\n", "\r\n"))
    path = str(tmp_path / "x.fasta")
    got = q.fasta_to_dataframe(spark, path, column_order=["entry", "geneName", "organism", "taxonomyId", "proteinExistence", "isoformStatus", "proteinDescription", "sequence", "molecularWeight_kDa"], return_result=True)
    rows = got.dataframe.collect()
    assert got.processed == 2 and got.skipped == {"length_filter": 1, "malformed_header": 1, "gene_filter": 0, "invalid_sequence": 1}
    assert rows[0].entry == "P11111" and rows[0].sequence == "ACDEFGHIKLMN" and rows[0].taxonomyId == 9606 and rows[0].organism == "Homo sapiens"
    assert rows[1].isoformStatus == "isoform" and rows[1].proteinExistence is None and rows[1].proteinDescription == "Second|piece" and rows[1].geneName is None
    assert rows[0].molecularWeight_kDa == pytest.approx(q.calc_molecular_weight("acdefghiklmn"), rel=1e-12)
    assert q.fasta_to_dataframe(spark, path, gene_only=True).count() == 1
    assert q.fasta_to_dataframe(spark, path, allow_ambiguous=False).count() == 1
    assert "sequence" not in q.fasta_to_dataframe(spark, path, include_sequence=False).columns
    with pytest.raises(q.ContractError):
        q.fasta_to_dataframe(spark, path, sort_by=["nope"])
    plain = q.read_fasta(spark, path).collect()
    assert len(plain) == 5 and plain[0].entry.startswith("sp|P11111|AAA1_X") and plain[0].sequence == "acdefghikLMN"
    (tmp_path / "i.fasta").write_text("\n >a b \n AC \n  > c\nGT")
    assert [tuple(r) for r in q.read_fasta(spark, str(tmp_path / "i.fasta")).collect()] == [("a b", "AC"), ("c", "GT")]
    (tmp_path / "n.fasta").write_text("")
    assert q.read_fasta(spark, str(tmp_path / "n.fasta")).count() == 0
    with pytest.raises(q.ContractError):
        q.read_fasta_entries(spark, str(tmp_path / "n.fasta"))
    (tmp_path / "e.fasta").write_text("ACD\n>x\nA\n")
    with pytest.raises(q.ContractError):
        q.read_fasta_entries(spark, str(tmp_path / "e.fasta"))
    with pytest.raises(q.ContractError):
        q.calc_molecular_weight("A1")


def test_design_and_dropped_samples(spark, peptides):
    design = q.DesignTable(("S1",), {"S1": "a"}, {"a": ("S1",)})
    assert {(r.sample_id, r.condition) for r in q.attach_conditions(peptides, design).collect()} == {("S1", "a"), *((f"S{i}", f"S{i}") for i in range(2, 7))}
    table, dropped = q.materialize_peptide_table(peptides, config().replace(conditions={"ctl": ("S1", "S2"), "trt": ("S4", "S5")}))
    assert dropped == ("S3", "S6") and table.count() == 32 and "qvalue" in q.VALID_METHODS


def test_settings(tmp_path):
    cfg = config(cluster_max_clusters=4)
    assert q.Config.from_yaml(cfg.to_yaml()) == cfg and cfg.condition_levels == ("ctl", "trt")
    q.Config.write_json_schema(tmp_path / "s.json")
    schema = json.loads((tmp_path / "s.json").read_text())
    assert set(schema["properties"]) == set(cfg.to_dict()) and schema["required"] == ["control_condition", "conditions"]
    assert q.Config.from_dict(cfg.to_dict() | {"cluster_max_clusters": "none"}).cluster_max_clusters is None
    bad = [{"fdr": 1.0}, {"min_peptides": 1}, {"model": "ebayes"}, {"cut": "x"}, {"linkage": "single"}, {"n_jobs": 0}, {"correction_global": "none"}, {"cluster_min_clusters": 5}, {"conditions": {"ctl": ("S1", "S2")}}, {"conditions": {"ctl": ("S1", "S2"), "t": ("S2", "S3")}}, {"control_condition": "?"}]
    for change in bad:
        with pytest.raises(q.ContractError):
            cfg.replace(**change)
    for data in ({"profile_aggregation": "mean"}, {"what": 1}):
        with pytest.raises(q.ContractError):
            q.Config.from_dict(cfg.to_dict() | data)


def test_stream_of_studies(spark, peptides, tmp_path):
    from quillon.streaming.increments import discordance_stream

    peptides.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(peptides.schema).parquet(str(tmp_path / "in"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        discordance_stream(stream, config(), lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [8]


def test_pi0_bootstrap(spark):
    """The registered query's method against the vector's, and registered with SQL."""
    import __spark_entry__
    from quillon.functions import correction
    from quillon.functions.qvalue import LAMBDAS, bootstrap

    assert "pi0_bootstrap" in __spark_entry__.queries() and "pi0_bootstrap" in __spark_entry__.oracle_sql()
    r = np.random.default_rng(4)
    for p in (np.concatenate([r.random(700), r.random(300) ** 4]), r.random(40)):
        counts = (p[:, None] > LAMBDAS).sum(0)
        got = correction.pi0_bootstrap(spark.createDataFrame([(float(x),) for x in p] + [(None,)], "p_value double")).collect()
        assert [x.pi0 for x in got] == pytest.approx([bootstrap(counts / (len(p) * (1 - LAMBDAS)), counts, len(p))])
    assert correction.pi0_bootstrap(spark.createDataFrame([], "p_value double")).first().pi0 == 1.0
