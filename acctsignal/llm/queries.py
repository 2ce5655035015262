"""The numbered queries of this package, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsignal.catalog.registry import query
from acctsignal.llm.batches import id_remainder
from acctsignal.llm.byte_bpe import decode_ids, encode_texts
from acctsignal.llm.fingerprints import fingerprint_edits
from acctsignal.llm.fixity import archived, audit
from acctsignal.llm.language import fit_languages, predict_language
from acctsignal.llm.licenses import license_summary, scan_licenses
from acctsignal.llm.packing import pack_documents
from acctsignal.llm.parity_join import near_duplicates
from acctsignal.llm.prefix_trie import branched, prefix_trie, sequences
from acctsignal.llm.quality import fit_quality, quality_score
from acctsignal.llm.shards import shard_documents
from acctsignal.llm.substrings import remove_repeated
from acctsignal.llm.topk import top_k
from acctsignal.llm.whitening import whiten
from acctsignal.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_language_filters(spark, sf_dir):
    """Language of every text, learned from the rows whose remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 4)
    model = fit_languages(docs.where(remainder != 2))
    return docs.select("doc_id", (remainder == 2).alias("held_out"),
                       predict_language(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


@query()
def op2_license_rules(spark, sf_dir):
    """Licences that every text names."""
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", *license_summary(F.col("licenses")))


@query("""
with r as (
  select page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ',
      coalesce(url, ''), chr(13), chr(10), 'Content-Length: ') as head,
    coalesce(html, '') as html, concat(chr(13), chr(10), chr(13), chr(10)) as gap,
    case when page_id % 53 = 7 then concat('#', substr(coalesce(html, ''), 2))
      else concat(substr(coalesce(html, ''), 1, length(coalesce(html, '')) - 10), '0000000000') end as damaged
  from pages),
d as (
  select page_id as record_id, page_id // 1000 as file,
    cast(strlen(concat(head, strlen(html), gap, html, gap)) as bigint) as length,
    sha256(concat(head, strlen(html), gap, html, gap)) as digest,
    sha256(concat(head, strlen(damaged), gap, damaged, gap)) as replica_digest
  from r),
o as (
  select *, coalesce(sum(length) over (partition by file order by record_id
    rows between unbounded preceding and 1 preceding), 0) as pos from d)
select file, cast(pos as bigint) as "offset", record_id, length, digest,
  case when record_id % 53 = 19 then null else replica_digest end as replica_digest,
  case when record_id % 53 = 19 then 'missing' else 'changed' end as damage
from o where record_id % 53 in (7, 11, 19)
""")
def op3_merkle_fixity(spark, sf_dir):
    """Damage in a replica of all pages as records of an archive.

    The replica is derived from the pages: of every 53 ids one has its first character overwritten, one its last ten,
    and one is lost.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind, html = F.col("page_id") % 53, F.coalesce("html", F.lit(""))
    damaged = (F.when(kind == 7, F.concat(F.lit("#"), F.substr(html, F.lit(2))))
               .when(kind == 11, F.concat(F.substr(html, F.lit(1), F.length(html) - 10), F.lit("0" * 10))).otherwise(html))
    original = archived(pages, 1000)
    replica = archived(pages.withColumn("html", damaged), 1000).where(~F.coalesce(F.col("record_id") % 53 == 19, F.lit(False)))
    return audit(original, replica)


@query()
def op4_jump_shards(spark, sf_dir):
    """All documents in 40 shards by id."""
    return shard_documents(table(spark, sf_dir, "documents"), 40)


@query()
def op5_merkle_fingerprints(spark, sf_dir):
    """Fingerprints of all texts and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op6_pair_index_bpe(spark, sf_dir):
    """Token ids of all texts, and the texts decoded from them."""
    path = vocabulary("byte_bpe_50k.json")
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return decode_ids(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Texts that score less are predicted to be bad.
QUALITY_THRESHOLD = 0.3


@query()
def op7_quality_ftrl(spark, sf_dir):
    """Quality of every text, learned from the labelled rows whose remainder by 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(F.col("doc_id"), 5)
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 5) != 0))
    scored = docs.select("doc_id", (remainder == 0).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


@query()
def op8_min_bin_slack(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    packed = pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query()
def op9_histogram_topk(spark, sf_dir):
    """The 10 best rows for each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query()
def op10_parity_join(spark, sf_dir):
    """Components of texts whose 3-word shingles are alike to 0.9."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=90)
    return found.select("doc_id", "n_shingles", "component_id")


#: crc32 of a decimal id, byte by byte and bit by bit.
_CRC32 = """(xor(list_reduce(list_prepend(4294967295::bigint, [ascii(ch)::bigint for ch in string_split(conv_id::varchar, '')]),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
        lambda x, k: xor(x >> 1, case when x % 2 = 1 then 3988292384::bigint else 0 end))), 4294967295::bigint))"""


@query(f"""with own as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first) as turns
  from conversations group by conv_id),
h as (select *, ({_CRC32} % 6)::int as h from own),
rebuilt as (
  select h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) as turns
  from h left join own b on b.conv_id = h.conv_id - h.conv_id % 100),
places as (select conv_id, d, turns[1:d] as prefix, d = len(turns) as is_end from rebuilt, unnest(range(0, len(turns) + 1)) t(d)),
nodes as (
  select prefix, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_end), '')) as ends_sha256
  from places group by prefix),
children as (select prefix[1:depth - 1] as prefix, count(*) as n from nodes where depth > 0 group by 1),
inner_nodes as (
  select nodes.*, coalesce(n, 0) as n_children,
    (n_convs - 1) * case when depth > 0 then length(nodes.prefix[depth].text) else 0 end as own
  from nodes left join children on children.prefix = nodes.prefix),
sums as (
  select prefix[1:d] as prefix, sum((n_children = 0)::int)::bigint as n_leaves, sum(own)::bigint as saved_tokens
  from inner_nodes, unnest(range(0, depth + 1)) t(d) group by 1)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
from inner_nodes n join sums on sums.prefix = n.prefix
left join nodes p on n.depth > 0 and p.prefix = n.prefix[1:n.depth - 1]""")
def op11_lcp_trie(spark, sf_dir):
    """Prefix trie of conversations that begin like another of their hundred."""
    own = materialize(sequences(table(spark, sf_dir, "conversations")), "sequences")
    return prefix_trie(branched(own, 100, 6))


@query(r"""with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select r, doc_id, i, array_to_string(w[i:i + 49], ' ') as s
  from d, unnest(range(1, len(w) - 48)) t(i) where len(w) >= 50 and doc_id is not null),
lowest as (select s, min(doc_id) as low from windows group by s),
gone as (select distinct r, i + k as pos from windows join lowest using (s), unnest(range(0, 50)) t(k) where low < doc_id),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
kept as (
  select words.r, count(*) as n, string_agg(word, ' ' order by words.pos) as kept
  from words left join gone on gone.r = words.r and gone.pos = words.pos where gone.r is null group by words.r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (r)""")
def op12_window_dedup(spark, sf_dir):
    """All documents without the words of 50-word windows that a smaller id has too."""
    found = remove_repeated(table(spark, sf_dir, "documents"), 50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op13_weighted_whitening(spark, sf_dir):
    """All vectors whitened to 32 components, a row per vector and component."""
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 32)
    found = rows.select("vec_id", "whitening.*")
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "of")
    return found.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained",
        "identity_error")
