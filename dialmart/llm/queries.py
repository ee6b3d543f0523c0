"""The opN queries: each operator over its whole table, with the digests that its contract asks for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, lines, media, merkle, mixing, packing, repeats, simhash, tokenfile, toxicity, variants, vectors, warc

#: The vocabulary file of op1 and op9, at the same place on every machine.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The vocabularies by which op11 measures fertility.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY, 4096, 1, with_ids=False)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    # archives that were written just now have no gaps; one is a fault, not fewer pages
    sound = F.when(F.col("gap").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("damaged archive: "), F.col("gap").cast("string"))).cast("boolean"))
    read = warc.read_archives(manifest).where(sound)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(_table(spark, sf_dir, "documents"), (5, 2, 1), 3.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        (F.length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(_table(spark, sf_dir, "documents")))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"), 2)
    return found.select("doc_id", "n_lines", "n_removed", "n_spans", F.md5(F.encode("kept", "UTF-8")).alias("kept_md5"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, ranks = tokenfile.write_token_files(_table(spark, sf_dir, "documents"), VOCABULARY, 2)
    return tokenfile.read_token_files(manifest, ranks, with_ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), 3, 3, 42)
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.quality(_table(spark, sf_dir, "documents"), RANKS, PIECES)
    return found.drop("lang")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    now = {"text": F.when(tampered, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))}
    proofs = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", now).proofs()
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"), 5, 3, 97, 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_embeddings": op4_embeddings,
    "op5_repeats": op5_repeats,
    "op6_toxicity": op6_toxicity,
    "op7_media": op7_media,
    "op8_lines": op8_lines,
    "op9_token_files": op9_token_files,
    "op10_simhash": op10_simhash,
    "op11_fertility": op11_fertility,
    "op12_manifest": op12_manifest,
    "op13_variants": op13_variants,
}


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's bytes, bit by bit."""
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda k: ('0x' || substr(hex({text}), 2 * k - 1, 2))::bigint)"
    bits = "list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, o: {bits}), 4294967295)"


#: Levels of the trees in the SQL of op12: 16 to the power of this is more than any group's leaves.
TREE_LEVELS = 5


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs <name>0, <name>1, ... with the nodes (g, pos, d) of each level, from leaves up; a lone node stays itself."""
    out = [f"{name}0 as ({leaves})"]
    for k in range(TREE_LEVELS):
        out.append(f"""{name}{k + 1} as (
            select g, pos // 16 as pos, case when any_value(m) = 1 then any_value(d) else sha256(string_agg(d, '' order by pos)) end as d
            from (select *, count(*) over (partition by g) as m from {name}{k}) group by g, pos // 16)""")
    return ", ".join(out)


def _fold_sql(name: str, start: str) -> str:
    """CTEs <name>w0, <name>w1, ... that carry rows of start (own, g, pos, fold, seen) up the tree."""
    out = [f"{name}w0 as ({start})"]
    for k in range(TREE_LEVELS):
        out.append(f"""{name}r{k} as (
            select g, pos // 16 as run, count(*) over (partition by g) as m, list(d) over (partition by g, pos // 16 order by pos rows between unbounded preceding and unbounded following) as ds, pos
            from {name}{k}), {name}w{k + 1} as (
            select own, g, w.pos // 16 as pos, case when m = 1 then fold else
                sha256(array_to_string(ds[:w.pos % 16], '') || fold || array_to_string(ds[w.pos % 16 + 2:], '')) end as fold,
                case when m = 1 then seen else seen || array_to_string(ds[:w.pos % 16], '') || array_to_string(ds[w.pos % 16 + 2:], '') end as seen
            from {name}w{k} w join {name}r{k} r using (g, pos))""")
    return ", ".join(out)


def _manifest_sql() -> str:
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(part, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    return f"""
        with hashed as (
            select doc_id, coalesce('1' || source, '0') as g, {leaf("text")} as leaf,
                case when {_crc32("doc_id::varchar")} % 5 = 0 then {leaf(lower)} else {leaf("text")} end as found
            from documents
        ), placed as (select *, row_number() over (partition by g order by doc_id) - 1 as pos from hashed),
        {_tree_sql("s", "select g, pos, leaf as d from placed")},
        {_tree_sql("t", f"select 0 as g, row_number() over (order by g) - 1 as pos, d from s{TREE_LEVELS}")},
        {_fold_sql("s", "select doc_id as own, g, pos, found as fold, '' as seen from placed")},
        ranked as (select g as source_g, d, row_number() over (order by g) - 1 as pos from s{TREE_LEVELS}),
        {_fold_sql("t", f"select own, 0 as g, r.pos, fold, seen from sw{TREE_LEVELS} w join ranked r on r.source_g = w.g")}
        select p.doc_id, p.leaf, r.d as subroot, o.d as root, sha256(w.seen) as proof_sha256, w.fold as folded_root, w.fold = o.d as verified
        from placed p join tw{TREE_LEVELS} w on w.own = p.doc_id join ranked r on r.source_g = p.g cross join t{TREE_LEVELS} o
    """

ORACLES: dict[str, str] = {
    "op12_manifest": _manifest_sql(),
    "op13_variants": f"""
        with recursive runs as (
            select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) as run from documents
        ), counted as (
            select doc_id, translate(run, '{UPPER}', '{UPPER.lower()}') as run, count(*) as n from runs group by 1, 2
        ), hashed as (
            select run, n, {_crc32("(doc_id::varchar || ':' || run)")} as h from counted
        ), words as (
            select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word,
                sum(n)::bigint as n
            from hashed group by 1 having length(word) >= 5 and sum(n) >= 3
        ), cut as (
            select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
            from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
        ), pairs as (
            select a.word, b.word as other, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
            union select c.word, w.word, w.n from cut c join words w on w.word = c.rest
            union select w.word, c.word, c.n from cut c join words w on w.word = c.rest
        ), near as (
            select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from pairs group by word
        ), forms as (
            select w.word, w.n, coalesce(n_near, 0) as n_near,
                case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
            from words w left join near using (word)
        ), chain as (
            select word, word as root from forms
            union all select c.word, f.form from chain c join forms f on f.word = c.root where f.form is not null
        )
        select f.word, f.n, f.n_near, f.form, f.form_n, c.root
        from forms f join chain c on c.word = f.word join forms e on e.word = c.root and e.form is null
    """,
    "op2_warc": """
        with rows as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
            from pages
        ), firsts as (
            select *, min(page_id) over (partition by payload_digest) as first_id from rows
        )
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to
        from firsts
    """,
    "op8_lines": """
        with split as (
            select doc_id, text, string_split(text, chr(10)) as parts from documents
        ), lines as (
            select doc_id, unnest(parts) as body, unnest(range(len(parts))) as line from split where text is not null
        ), full_lines as (
            select *, row_number() over (partition by doc_id order by line) as place
            from lines where trim(translate(body, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> ''
        ), runs as (
            select doc_id, place, body, lead(body) over (partition by doc_id order by place) as next_body
            from full_lines
        ), later as (
            select doc_id, place from (
                select doc_id, place, min(doc_id * 1000000 + place) over (partition by body, next_body) as first_place
                from runs where next_body is not null
            ) where first_place < doc_id * 1000000 + place
        ), covered as (
            select doc_id, place from later union select doc_id, place + 1 from later
        ), marked as (
            select l.doc_id, l.line, l.body, c.place is not null as gone
            from lines l left join full_lines f using (doc_id, line)
            left join covered c on c.doc_id = f.doc_id and c.place = f.place
        ), edges as (
            select *, gone and not coalesce(lag(gone) over (partition by doc_id order by line), false) as begins
            from marked
        )
        select d.doc_id, count(e.line) as n_lines, count(*) filter (e.gone) as n_removed,
            count(*) filter (e.begins) as n_spans,
            case when d.text is not null then
                md5(coalesce(string_agg(e.body, chr(10) order by e.line) filter (not e.gone), '')) end as kept_md5
        from documents d left join edges e using (doc_id) group by d.doc_id, d.text
    """,
}
