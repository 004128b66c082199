"""The registered queries of this subpackage: thin adapters from operators to the columns asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.llm.common import fold, table


def op1_substring_dedup(spark, sf_dir):
    from lintel.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), width=50).drop("kept")


def op2_packing(spark, sf_dir):
    import public_tokenizers

    from lintel.llm.packing import pack, word_bpe

    return pack(table(spark, sf_dir, "documents"), word_bpe(public_tokenizers.path("word_bpe_49k.json")), size=2048, end_id=1)


def _with_fold(scored):
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op3_toxicity(spark, sf_dir):
    from lintel.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return _with_fold(score(docs, train(docs, table(spark, sf_dir, "labels"))))


def op10_quality_classifier(spark, sf_dir):
    from lintel.llm.quality_classifier import score, train

    docs = table(spark, sf_dir, "documents")
    return _with_fold(score(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3))


def op4_warc(spark, sf_dir):
    from lintel.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secret_scan(spark, sf_dir):
    from lintel.llm.secret_scan import named, scan, train

    docs = table(spark, sf_dir, "documents")
    rows = scan(docs, train(docs)).select(F.col("row.doc_id").alias("doc_id"), "found", F.filter("found", lambda x: x["kind"] < 3).alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("found")).alias("spans"))


def op6_html_text(spark, sf_dir):
    from lintel.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_simhash(spark, sf_dir):
    from lintel.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), ngram=3, bits=64, width=64, budget=3, similarity=None)


def op8_quality_rules(spark, sf_dir):
    from lintel.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).drop("lang", "source")


def op9_decontamination(spark, sf_dir):
    from lintel.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark, sf_dir):
    from lintel.llm.source_divergence import audit

    return audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    from lintel.llm.token_alignment import align, byte_and_piece

    return align(table(spark, sf_dir, "documents"), byte_and_piece(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")))


def op13_best_fit(spark, sf_dir):
    import public_tokenizers

    from lintel.llm.best_fit import pack
    from lintel.llm.packing import word_bpe

    return pack(table(spark, sf_dir, "documents"), word_bpe(public_tokenizers.path("word_bpe_49k.json")), size=4096, end_id=1)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    return {
        "op4_warc": """
            with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
                 f as (select html, min(page_id) as first_id from p where n >= 100 group by html)
            select p.page_id, cast(p.n as bigint) as payload_bytes, sha256(p.html) as payload_digest,
                   case when f.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
                   case when f.first_id <> p.page_id then f.first_id end as refers_to
            from p left join f on p.html = f.html""",
        "op11_source_divergence": r"""
            with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
                 w as (select id, lang, source, unnest(terms) as term from d),
                 c as (select lang, source, term, count(*) as n from w group by all),
                 k as (select lang, term, count(*) as n from w group by all having count(distinct id) >= 30),
                 l as (select lang, count(*) as v, sum(n) as total from k group by lang),
                 g as (select lang, source from d group by all),
                 -- every source with every kept term of its language
                 a as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as n_lang from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
                 t as (select lang, source, sum(n) as total from a group by all),
                 p as (select a.*, cast(1 + (1000000000::hugeint * (a.n + 5)) // (t.total::hugeint + 5 * l.v) as bigint) as p,
                              cast(1 + (1000000000::hugeint * (n_lang + 5)) // (l.total::hugeint + 5 * l.v) as bigint) as q
                       from a join t using (lang, source) join l using (lang)),
                 x as (select p.lang, p.source, o.source as item, sum(abs(p.p - o.p)) as value from p join p o on p.lang = o.lang and p.term = o.term and p.source <> o.source group by all),
                 r as (select g.lang, g.source, 'pair' as part, o.source as item, cast(coalesce(x.value, 0) as bigint) as value
                       from g join g o on g.lang = o.lang and g.source <> o.source left join x on x.lang = g.lang and x.source = g.source and x.item = o.source
                       union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
                 n as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r)
            select * from n where part = 'pair' or rank <= 50""",
    }
