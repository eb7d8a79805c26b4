"""Registered queries of this folder, and SQL where SQL can express them.

The SQL of the two joins compares all pairs; it is meant for small folders.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from staylens.llm import (
    bpe_trie, chat_format, embed_dedup, exact_dedup, fingerprints, jaccard_join, license_scan, merkle, packing, quality,
    secret_scan, spelling, toxicity,
)
from staylens.llm.common import table, text_or_empty

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    same = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat_format.digest(chat_format.format_turns(chat_format.text_parts(turns)))


def held_out(doc_id="doc_id"):
    """Rows whose labels no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels").where(~held_out()))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out()))
    return toxicity.score(docs, net).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", "window_start", "n_words")


def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_dedup(table(spark, folder, "embeddings"))


def op6_bpe_trie(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe_trie.encode_decode(docs, TOKENIZER, with_ids=False, with_text=False)


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secret_scan.scan(docs, path_col="source")
    starts = F.transform("findings", lambda m: m["start"])
    return found.select(
        "doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"),
        F.array_min(starts).cast("long").alias("first_start"),
        F.array_join(F.transform("findings", lambda m: F.concat_ws("-", m["start"], m["length"])), ",").alias("spans"),
        F.sha2(F.array_join(F.transform("findings", lambda m: m["value"]), "\n"), 256).alias("secrets_sha256"),
    )


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, folder, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"), shingle=3, num=90, den=100)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    digest = {"text_sha256": F.sha2(text_or_empty(), 256)}
    return exact_dedup.exact_dedup(table(spark, folder, "documents"), carry=digest)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(
        table(spark, folder, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang",
        presented={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root", "verified")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_groups(spelling.count_words(table(spark, folder, "documents"), every=97))


def op13_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_chat_formatting, op3_quality_classifier, op4_toxicity, op5_embedding_near_dedup,
    op6_bpe_trie, op7_secret_scan, op8_license_scan, op9_ngram_jaccard_join, op10_exact_dedup,
    op11_merkle_manifest, op12_spelling_variants, op13_document_fingerprints,
)}

# CRC-32 of a text of ASCII characters.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(string_split({0}, ''), lambda c: ord(c)::bigint)), lambda a, x: list_reduce(
        [xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""


SQL = {
    "op2_chat_formatting": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
            sum(16 + 2 * length(role || text) - length(regexp_replace(role || text, '[\\<>]', '', 'g')))::bigint
                as formatted_chars
        from turns group by conv_id""",
    "op5_embedding_near_dedup": """
        with recursive usable as (
            select vec_id, label, embedding::double[] as e from embeddings
            where label is not null and len(embedding) > 0
                and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
                and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (
            select a.vec_id as a, b.vec_id as b from usable a join usable b
            on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
                and list_cosine_similarity(a.e, b.e) >= 0.98),
        reach as (
            select vec_id as a, vec_id as b from embeddings
            union select r.a, l.b from reach r join links l on r.b = l.a),
        counted as (select a, count(*) as n from links group by a)
        select r.a as vec_id, coalesce(max(c.n), 0)::bigint as n_links, min(r.b) as component_id,
            r.a = min(r.b) as kept
        from reach r left join counted c on c.a = r.a group by r.a""",
    "op9_ngram_jaccard_join": """
        with recursive words as (
            select doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
        sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 1),
                    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
        shingles as (select doc_id, unnest(s) as x from sets),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a
            join shingles b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
        links as (
            select p.a, p.b from shared p join sets x on x.doc_id = p.a join sets y on y.doc_id = p.b
            where 100 * p.n >= 90 * (len(x.s) + len(y.s) - p.n)),
        reach as (
            select doc_id as a, doc_id as b from documents
            union select r.a, l.b from reach r join links l on r.b = l.a)
        select s.doc_id, len(any_value(s.s))::bigint as n_shingles, min(r.b) as component_id
        from sets s join reach r on r.a = s.doc_id group by s.doc_id""",
    "op10_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
            doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op11_merkle_manifest": f"""
        with recursive fields as (
            select *, {CRC32.format("doc_id::varchar")} % 7 = 0 as tampered,
                coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') as f1,
                coalesce(strlen(source) || ':' || source, '-') as f2,
                coalesce(strlen(lang) || ':' || lang, '-') as f3,
                coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as f4,
                coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as f4_shown,
                coalesce(strlen(text) || ':' || text, '-') as f5 from documents),
        leaves as (
            select doc_id, lang, sha256(f1 || f2 || f3 || f4 || f5) as leaf,
                sha256(f1 || f2 || f3 || case when tampered then f4_shown else f4 end || f5) as shown,
                dense_rank() over (order by lang nulls first) - 1 as tree,
                row_number() over (partition by lang order by doc_id) - 1 as pos,
                count(*) over (partition by lang) as n from fields),
        nodes as (
            select tree, 0 as level, pos, n, leaf as hash from leaves
            union all select tree, level + 1, pos // 2, (n + 1) // 2, sha256(hash || after) from (
                select *, coalesce(lead(hash) over (partition by tree order by pos), '') as after
                from nodes where n > 1) where pos % 2 = 0),
        subroots as (select tree, hash as subroot, count(*) over () as trees from nodes where n = 1),
        tops as (
            select 0 as level, tree as pos, trees as n, subroot as hash from subroots
            union all select level + 1, pos // 2, (n + 1) // 2, sha256(hash || after) from (
                select *, coalesce(lead(hash) over (order by pos), '') as after from tops where n > 1)
            where pos % 2 = 0),
        folds as (
            select doc_id, tree, 0 as level, pos, n, shown as hash, '' as proof from leaves
            union all select f.doc_id, f.tree, f.level + 1, f.pos // 2, (f.n + 1) // 2,
                sha256(case when f.pos % 2 = 0 then f.hash || coalesce(s.hash, '') else s.hash || f.hash end),
                f.proof || coalesce(s.hash, '')
            from folds f left join nodes s on s.tree = f.tree and s.level = f.level and s.pos = xor(f.pos, 1)
            where f.n > 1),
        over_folds as (
            select doc_id, 0 as level, f.tree as pos, s.trees as n, hash, proof from folds f
                join subroots s on s.tree = f.tree where f.n = 1
            union all select f.doc_id, f.level + 1, f.pos // 2, (f.n + 1) // 2,
                sha256(case when f.pos % 2 = 0 then f.hash || coalesce(s.hash, '') else s.hash || f.hash end),
                f.proof || coalesce(s.hash, '')
            from over_folds f left join tops s on s.level = f.level and s.pos = xor(f.pos, 1) where f.n > 1)
        select l.doc_id, l.leaf, s.subroot, r.hash as root, sha256(f.proof) as proof_sha256, f.hash as folded_root,
            f.hash = r.hash as verified
        from leaves l join subroots s on s.tree = l.tree join over_folds f on f.doc_id = l.doc_id and f.n = 1
        join tops r on r.n = 1""",
    "op12_spelling_variants": r"""
        with recursive crc_table as (
            select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
                lambda y, z: xor(y >> 1, (y & 1) * 3988292384)) order by i) as t from range(256) r(i)),
        runs as (
            select doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[a-z\x{C0}-\x{FF}]+')) as run from documents where text is not null),
        counted as (select doc_id, run, count(*) as n from runs group by 1, 2),
        bytes as (
            select doc_id, run, n, list_transform(string_split(hex(encode(doc_id || ':' || run)), ''),
                lambda c: instr('0123456789ABCDEF', c) - 1) as d from counted),
        hashed as (
            select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(
                range(1, len(d), 2), lambda i: (d[i] * 16 + d[i + 1])::bigint)),
                lambda a, x: xor(t[xor(a, x) % 256 + 1], a >> 8))) as h from bytes, crc_table),
        edited as (
            select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint)
                || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
        words as (
            select word, sum(n)::bigint as n from edited where length(word) >= 5 group by 1 having sum(n) >= 3),
        cuts as (
            select word, word as cut from words
            union select word, substr(word, 1, i - 1) || substr(word, i + 1) from
                (select word, unnest(range(1, length(word) + 1)) as i from words)),
        holes as (
            select word, substr(word, 1, i - 1) || '_' || substr(word, i + 1) as hole from
                (select word, unnest(range(1, length(word) + 1)) as i from words)),
        pairs as (
            select a.word, b.word as near from holes a join holes b on a.hole = b.hole and a.word <> b.word
            union select a.word, b.word from cuts a join words b on a.cut = b.word and a.word <> b.word
            union select b.word, a.word from cuts a join words b on a.cut = b.word and a.word <> b.word),
        ranked as (
            select p.word, x.n, p.near, y.n as near_n, count(*) over (partition by p.word) as n_near,
                row_number() over (partition by p.word order by y.n desc, encode(p.near)) as place
            from pairs p join words x on x.word = p.word join words y on y.word = p.near),
        forms as (
            select w.word, w.n, coalesce(r.n_near, 0) as n_near,
                case when r.near_n >= 2 * w.n then r.near end as form,
                case when r.near_n >= 2 * w.n then r.near_n end as form_n
            from words w left join ranked r on r.word = w.word and r.place = 1),
        chain as (
            select word, word as at, 0 as step from forms
            union all select c.word, f.form, c.step + 1 from chain c join forms f on f.word = c.at
            where f.form is not null)
        select f.word, f.n, f.n_near, f.form, f.form_n, arg_max(c.at, c.step) as root
        from forms f join chain c on c.word = f.word group by all""",
}
