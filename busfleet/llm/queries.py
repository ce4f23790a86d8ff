"""The registered queries of this subpackage, with production parameters, and their SQL."""

import public_tokenizers

from busfleet.llm import byte_bpe, chat, cross_tokenizer, decontaminate, exact_dedup, language_model, merkle, minhash, quality, suffix_dedup, toxicity, vectors, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


ODD_TEXT = r"\### Assistant: </turn> ok"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op1_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0).drop("url")


def op2_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_language_model(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.decisions(table(spark, sf_dir, "documents")).drop("copies")


def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op11_cross_tokenizer(spark, sf_dir):
    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return cross_tokenizer.aligned(table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)


def op12_merkle(spark, sf_dir):
    return merkle.verified(table(spark, sf_dir, "documents"), merkle.lower_cased())


def op13_vectors(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op9_chat(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, k, role, ODD_TEXT) for k, role in enumerate(("user", "assistant"))], conversations.schema)
    return chat.digests(chat.read_back(*chat.formatted(conversations.unionByName(own))))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_model": op4_language_model,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_chat": op9_chat,
    "op10_minhash": op10_minhash,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_merkle": op12_merkle,
    "op13_vectors": op13_vectors,
}

#: Base32 of a SHA-1 in SQL: every five hex digits give four characters.
BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, {5 * j + 1}, 5) as int) >> {shift}) & 31), 1)" for j in range(8) for shift in (15, 10, 5, 0))

#: The fields of a leaf in SQL.
FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))

ORACLE = {
    "op13_vectors": """
        with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
        links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
        reach as (select vec_id as x, vec_id as y from v union select r.x, l.y from reach r join links l on l.x = r.y)
        select r.x as vec_id, (select count(*) from links l where l.x = r.x) as n_links, min(r.y) as component_id, min(r.y) = r.x as kept
        from reach r group by r.x""",
    "op12_merkle": f"""
        with recursive d as (
            select *, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
                lambda v, c: list_reduce([xor(v, c)] || range(8), lambda w, i: xor(w >> 1, 3988292384 * (w & 1))))) as crc
            from documents),
        l as (
            select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as pos, dense_rank() over (order by source nulls first) - 1 as sid,
                sha256({FIELDS.replace("{text}", "text")}) as leaf,
                sha256({FIELDS.replace("{text}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) as lowered, crc
            from d),
        t as (
            select 0 as level, sid, pos, leaf as h, count(*) over (partition by sid) as n from l
            union all
            select level + 1, sid, pos // 16, sha256(string_agg(h, '' order by pos)), (any_value(n) + 15) // 16 from t where n > 1 group by level, sid, pos // 16),
        s as (select sid, h as subroot, level as height from t where n = 1),
        u as (
            select 0 as level, sid as pos, subroot as h, count(*) over () as n from s
            union all
            select level + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (any_value(n) + 15) // 16 from u where n > 1 group by level, pos // 16),
        node as (
            select sid, level, pos, h from t where n > 1
            union all select s.sid, s.height + u.level, u.pos, u.h from u, s where u.n > 1),
        want as (
            select l.doc_id, level, sid, (l.pos // cast(pow(16, level) as bigint)) as pos from l join s using (sid), unnest(range(height)) as r(level)
            union all
            select l.doc_id, s.height + k, sid, sid // cast(pow(16, k) as bigint) from l join s using (sid), (select distinct level as k from u where n > 1)),
        step as (
            select w.doc_id, w.level, coalesce(string_agg(n.h, '' order by n.pos) filter (n.pos < w.pos), '') as a, coalesce(string_agg(n.h, '' order by n.pos) filter (n.pos > w.pos), '') as b
            from want w join node n on n.sid = w.sid and n.level = w.level and n.pos // 16 = w.pos // 16 group by all),
        f as (
            select doc_id, 0 as level, case when crc % 5 = 0 then coalesce(lowered, leaf) else leaf end as h from l
            union all select f.doc_id, f.level + 1, sha256(a || h || b) from f join step using (doc_id, level))
        select l.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, x.h as folded_root, x.h = root as verified
        from l join s using (sid) cross join (select h as root from u where n = 1)
        left join (select doc_id, sha256(string_agg(a || b, '' order by level)) as proof from step group by doc_id) using (doc_id)
        join (select doc_id, arg_max(h, level) as h from f group by doc_id) x using (doc_id)""",
    "op1_warc": f"""
        with p as (select page_id, coalesce(html, '') as t from pages),
        d as (select page_id, octet_length(encode(t)) as n, sha1(t) as h, min(page_id) over (partition by t) as f from p)
        select page_id, cast(n as bigint) as payload_bytes, {BASE32} as payload_digest,
            case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to
        from d""",
    "op10_minhash": r"""
        with recursive d as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents),
        s as (
            select distinct doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as shingle
            from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
            union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 2),
        n as (select doc_id, count(*) as n from s group by doc_id),
        c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
        l as (
            select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
        both_ways as (select x, y from l union all select y, x from l),
        reach as (select doc_id as x, doc_id as y from documents union select r.x, e.y from reach r join both_ways e on e.x = r.y)
        select r.x as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.y) as component_id, min(r.y) = r.x as kept
        from reach r left join n on n.doc_id = r.x group by r.x""",
    "op9_chat": r"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        a as (
            select conv_id, count(*) as n_turns,
                string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
                coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
                sum(length(role) + length(text) + 22
                    + length(regexp_replace(role || text, '[^\\<>"]', '', 'g'))) as formatted_chars
            from c group by conv_id)
        select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
            sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
        from a""",
    "op7_exact_dedup": r"""
        with d as (
            select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h
            from documents)
        select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
            doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256
        from d""",
}
