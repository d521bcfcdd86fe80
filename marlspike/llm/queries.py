"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm import chat, decontaminate, mixing, pii, ranking, secrets, simhash, sstable, supervision, toxicity
from marlspike.llm.labels import remainder
from marlspike.session import table

#: A key for the registered query; a real run brings its own from a secret store.
DEMO_KEY = b"marlspike demonstration key"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_and_index(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def held_out_scores(docs: DataFrame, model, module, modulus: int, rest: int) -> DataFrame:
    held = F.coalesce(remainder(F.col("doc_id"), modulus) == rest, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), module.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return held_out_scores(docs, model, toxicity, 4, 2)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ranking.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return held_out_scores(docs, model, ranking, 5, 0)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = supervision.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(table(spark, sf_dir, "documents"), DEMO_KEY)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sstable, op2_toxicity, op3_secrets, op4_decontaminate, op5_simhash, op6_mix, op7_quality, op8_rules, op9_pseudonyms, op10_chat, pipeline)}

ORACLES = {
    "op6_mix": r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as k
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), w as (
  select *, (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as weight, 3 * source_size as room from s
), f as (
  select *, row_number() over o as place,
         (sum(source_size) over () - coalesce(sum(room) over (o rows between unbounded preceding and 1 preceding), 0))
           / cast(sum(weight) over (o rows between current row and unbounded following) as double) as share
  from w window o as (order by room / weight, source asc nulls last)
), t as (
  select source, source_size, case when room <= weight * share then cast(room as double)
         else weight * (select f2.share from f f2 where not f2.room <= f2.weight * f2.share order by f2.place limit 1) end as target
  from f
), c as (
  select d.*, t.source_size, t.target, coalesce(cast(floor(t.target) as bigint) // nullif(t.source_size, 0), 0) as epochs
  from sized d join t on d.source is not distinct from t.source
), r as (
  select *, cast(floor(target) as bigint) - epochs * source_size as rest, sum(size) over (partition by source order by k) as upto,
         sum(size) over (partition by source, k) as tied
  from c
)
select doc_id, size, source_size, target,
       cast(epochs * size + case when upto <= rest then size when upto - tied < rest then floor((rest - upto + tied) * size / tied) else 0 end as bigint) as taken
from r
""",
    "op10_chat": r"""
with t as (
  select distinct conv_id, coalesce(turn, -9223372036854775808) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
), p as (
  select *, dense_rank() over (partition by conv_id order by turn) as place from t
), c as (
  select conv_id, count(*) as n_turns, list((place, role, text) order by place, role, text) as turns,
         string_agg('<|' || replace(role, '<|', '<\|') || '|>' || chr(10) || replace(text, '<|', '<\|') || chr(10), '' order by turn, role, text) as rendered
  from p group by conv_id
), whole as (
  select min(conv_id) as conv_id, n_turns, turns, any_value(rendered) as rendered from c group by n_turns, turns
)
select conv_id, n_turns, rendered from whole a
where not exists (
  select 1 from whole b where b.turns[1] = a.turns[1] and b.n_turns > a.n_turns and b.turns[1:a.n_turns] = a.turns
)
""",
}
