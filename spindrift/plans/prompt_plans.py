"""Records of training and evaluation sets with all their fields; retrieval records; seeded orders that SQL can make too."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import scores as P
from spindrift.functions import text as T
from spindrift.operators import batch as B
from spindrift.operators import records as R
from spindrift.operators import search as S
from spindrift.plans import views as V
from spindrift.plans.registry import query, r6, table
from spindrift.plans.shape_plans import shp_gsm8k

#: What a problem's text ends with.
BOXED = "Let's think step by step and output the final answer within \\boxed{}."
THINK = "You FIRST think about the reasoning process as an internal monologue and then provide the final answer. The reasoning process MUST BE enclosed within <think> </think> tags. The final answer MUST BE put in \\boxed{}."


def _flat(*keys: str) -> list[F.Column]:
    """Fields of a record: prompt is the last turn's text."""
    at = {"prompt": F.element_at("prompt", -1)["content"], "role": F.element_at("prompt", -1)["role"], "style": F.col("reward_model.style"), "truth": F.col("reward_model.ground_truth"), "split": F.col("extra_info.split"), "index": F.col("extra_info.index")}
    return [at.get(k, F.col(k)).alias(k) for k in keys]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("shp_math", f"SELECT id, 'lighteval/MATH' AS data_source, 'Find ' || answer || '. ' || {_quoted(BOXED)} AS prompt, 'math' AS ability, 'rule' AS style, '\\frac{{' || l_linenumber || '}}{{7}}' AS truth, CASE WHEN l_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, row_number() OVER (PARTITION BY l_partkey % 5 = 0 ORDER BY id, answer) - 1 AS index FROM predictions", "predictions")
def shp_math(spark, d):
    """Problems with worked solutions, whose last boxed text is the truth."""
    test = F.col("l_partkey") % 5 == 0
    p = V.predictions(spark, d)
    rows = B.numbered(p.where(~test), "id", "answer").unionByName(B.numbered(p.where(test), "id", "answer"))
    solution = F.concat(F.lit("First \\boxed{1}, then it gives $\\boxed{\\frac{"), F.col("l_linenumber").cast("string"), F.lit("}{7}}$."))
    content = F.concat(F.lit("Find "), "answer", F.lit(". " + BOXED))
    record = R.rl_record("lighteval/MATH", content, "math", "rule", P.boxed(solution), F.when(test, "test").otherwise("train"), F.col("rn"))
    return rows.select("id", *record).select("id", *_flat("data_source", "prompt", "ability", "style", "truth", "split", "index"))


@query("shp_gsm8k_tool", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ['system', 'user'] AS roles, 'Q' || l_partkey || ' Let''s think step by step and output the final answer after \"####\".' AS prompt, CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) AS truth, CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) AS tool_truth, true AS need_tools_kwargs FROM lineitem")
def shp_gsm8k_tool(spark, d):
    """A system turn that asks for the tool, and what the tool needs to be set up for the row."""
    rows = shp_gsm8k(spark, d)
    record = R.rl_record("openai/gsm8k", F.col("prompt"), "math", "rule", F.col("truth"), F.lit("train"), F.col("l_linenumber"), system="Use the calc_gsm8k_reward tool to check the answer before you give it.")
    x = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *record).withColumn("extra_info", R.with_tool(F.col("extra_info"), F.col("reward_model.ground_truth"), "calc_gsm8k_reward"))
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.transform("prompt", lambda m: m["role"]).alias("roles"), *_flat("prompt", "truth"), F.col("extra_info.tools_kwargs.calc_gsm8k_reward.create_kwargs.ground_truth").alias("tool_truth"), F.col("extra_info.need_tools_kwargs").alias("need_tools_kwargs"))


@query("shp_geo3k", f"SELECT page_id, 'hiyouga/geometry3k' AS data_source, '<image>' || url || ' ' || {_quoted(THINK)} AS prompt, 'rule' AS style, CAST(page_id % 97 AS VARCHAR) AS truth, 'test' AS split, row_number() OVER (ORDER BY page_id) - 1 AS index, '<image>' || url AS question, 1 AS images, octet_length(encode(html)) AS bytes FROM pages")
def shp_geo3k(spark, d):
    """Problems with their images as bytes (the pages' html stands for them)."""
    p = B.numbered(table(spark, d, "pages"), "page_id")
    truth, problem = (F.col("page_id") % 97).cast("string"), F.concat(F.lit("<image>"), "url")
    record = R.rl_record("hiyouga/geometry3k", F.concat(problem, F.lit(" " + THINK)), "math", "rule", truth, F.lit("test"), F.col("rn"), answer=truth, question=problem)
    x = p.select("page_id", *record, F.array(F.col("html").cast("binary")).alias("images"))
    return x.select("page_id", *_flat("data_source", "prompt", "style", "truth", "split", "index"), F.col("extra_info.question").alias("question"), F.size("images").alias("images"), F.octet_length(F.col("images")[0]).cast("long").alias("bytes"))


@query("shp_hh_rl", "SELECT item_id, 'Dahoas/full-hh-rlhf' AS data_source, text AS prompt, 'user' AS role, 'alignment' AS ability, 'model' AS style, reverse(text) AS truth, 'train' AS split, row_number() OVER (ORDER BY item_id) - 1 AS index FROM benchmark")
def shp_hh_rl(spark, d):
    """Prompts of preference data; the response is kept as a truth that a model's reward does not use."""
    b = B.numbered(table(spark, d, "benchmark").withColumn("response", F.reverse("text")), "item_id")
    record = R.rl_record("Dahoas/full-hh-rlhf", F.col("text"), "alignment", "model", F.col("response"), F.lit("train"), F.col("rn"))
    return b.select("item_id", *record).select("item_id", *_flat("data_source", "prompt", "role", "ability", "style", "truth", "split", "index"))


@query("shp_retool", "WITH c AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id), r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) - 1 AS rn, floor((SELECT count(*) FROM c) * 0.9)::BIGINT AS cut FROM c) SELECT conv_id, 'swordfaith/ReTool-SFT-multi-turn' AS data_source, to_json(m)::VARCHAR AS messages, '[{\"name\":\"code_interpreter\"}]' AS tools, false AS enable_thinking, CASE WHEN rn < cut THEN 'train' ELSE 'test' END AS split, CASE WHEN rn < cut THEN rn ELSE rn - cut END AS index FROM r")
def shp_retool(spark, d):
    """Whole conversations with their tools, nine tenths in a seeded order for training."""
    m = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("messages"))
    rows = R.split_at(whole, 0.9, 42, "conv_id")
    tools = F.array(F.struct(F.lit("code_interpreter").alias("name")))
    x = rows.select("conv_id", F.lit("swordfaith/ReTool-SFT-multi-turn").alias("data_source"), "messages", tools.alias("tools"), F.lit(False).alias("enable_thinking"), F.struct("split", "index").alias("extra_info"))
    return x.select("conv_id", "data_source", F.to_json("messages").alias("messages"), F.to_json("tools").alias("tools"), "enable_thinking", "extra_info.split", "extra_info.index")


def _exam(spark, d, langs, source, ability):
    """Questions of some languages as records, numbered within each language, one set after the other."""
    parts = []
    for lang, name in langs:
        own = B.numbered(table(spark, d, "documents").where(F.col("lang") == lang), "doc_id")
        parts.append(own.select("doc_id", *R.rl_record(name or source, F.col("text"), ability, "rule", F.col("n_chars").cast("string"), F.lit("test"), F.col("rn"))))
    return B.concat(*parts).select("doc_id", *_flat("data_source", "prompt", "ability", "style", "truth", "split", "index"))


_EXAM = "SELECT doc_id, {source} AS data_source, text AS prompt, '{ability}' AS ability, 'rule' AS style, CAST(n_chars AS VARCHAR) AS truth, 'test' AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS index FROM documents WHERE lang IN ({langs})"


@query("shp_r1_aime", _EXAM.format(source="'Maxwell-Jia/AIME_2024'", ability="English", langs="'en'"))
def shp_r1_aime(spark, d):
    """One set; an answer that is a number becomes text."""
    return _exam(spark, d, [("en", None)], "Maxwell-Jia/AIME_2024", "English")


@query("shp_r1_cnmo", _EXAM.format(source="CASE lang WHEN 'en' THEN 'opencompass/cnmo2024_en' ELSE 'opencompass/cnmo2024_zh' END", ability="Math", langs="'en', 'de'"))
def shp_r1_cnmo(spark, d):
    """Two sets of two languages, each with its own source and numbers."""
    return _exam(spark, d, [("en", "opencompass/cnmo2024_en"), ("de", "opencompass/cnmo2024_zh")], "", "Math")


_GPQA = "WITH b AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS rn, (SELECT count(*) FROM benchmark) AS n FROM benchmark)"


@query("shp_r1_gpqa", f"{_GPQA} SELECT a.item_id, a.text AS right, list(w.text ORDER BY w.text) AS wrong, 4 AS options, true AS placed FROM b a JOIN b w ON w.rn IN ((a.rn + 1) % a.n, (a.rn + 2) % a.n, (a.rn + 3) % a.n) GROUP BY a.item_id, a.text")
def shp_r1_gpqa(spark, d):
    """The next three items' texts (from the start again after the last) are the wrong options; the right one stands where the label says."""
    b = B.numbered(table(spark, d, "benchmark"), "item_id")
    n = b.count()
    asked = b.select("item_id", "text", F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: (F.col("rn") + k) % n)).alias("at"))
    wrong = asked.join(b.select(F.col("rn").alias("at"), F.col("text").alias("other")), "at").groupBy("item_id", "text").agg(F.sort_array(F.collect_list("other")).alias("wrong"))
    shown, label = R.options(F.col("wrong"), F.col("text"), F.col("item_id"), 42)
    x = wrong.select("item_id", F.col("text").alias("right"), "wrong", shown.alias("options"), label.alias("label"))
    placed = (F.element_at("options", F.ascii("label") - 64) == F.col("right")) & (F.sort_array(F.filter("options", lambda o: o != F.col("right"))) == F.col("wrong"))
    return x.select("item_id", "right", "wrong", F.size("options").alias("options"), placed.alias("placed"))


@query("shp_char_count", r"""WITH o AS (SELECT o_orderkey, substr('abcdefghijklmnopqrstuvwxyz', o_custkey % 26 + 1, 1) AS asked, list_transform(range(0, 3 + o_orderkey % 3), lambda i: substr('abcdefghijklmnopqrstuvwxyz', CASE WHEN (o_orderkey + i) % 3 = 0 THEN o_custkey % 26 + 1 ELSE (o_orderkey * 7 + i * 5) % 26 + 1 END, 1)) AS ls FROM orders),
  w AS (SELECT *, len(list_filter(ls, lambda c: c = asked)) AS hits, array_to_string(ls, '-') AS word FROM o)
  SELECT o_orderkey, 'char_count' AS data_source, 'How many ' || asked || ' are there in word ' || word || '?' AS prompt, CAST(hits AS VARCHAR) AS truth, array_to_string(list_transform(ls, lambda c: c || CASE WHEN c = asked THEN ' = ' ELSE ' != ' END || asked || '.' || chr(10)), '') || '\boxed{' || hits || '} ' || asked || ' in ' || word || '.' AS response FROM w""")
def shp_char_count(spark, d):
    """A task of counting letters from each order's numbers, worked out, as a record."""
    at = lambda c: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (c % 26 + 1).cast("int"), F.lit(1))
    asked = at(F.col("o_custkey"))
    own = lambda i: F.when((F.col("o_orderkey") + i) % 3 == 0, asked).otherwise(at(F.col("o_orderkey") * 7 + i * 5))
    letters = F.transform(F.sequence(F.lit(0).cast("long"), 2 + F.col("o_orderkey") % 3), own)
    x = R.as_rl(R.count_letters(table(spark, d, "orders").select("o_orderkey", asked.alias("asked"), letters.alias("letters"))), "o_orderkey")
    return x.select("o_orderkey", "data_source", F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("truth"), "extra_info.response")


@query("shp_digit", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 21 AS a, (l_partkey % 21 + l_linenumber) % 20 AS s, l_suppkey % 6 AS n FROM lineitem),
  t AS (SELECT *, a || ',' || s || ':20,' || n AS prompt, coalesce(array_to_string(list_transform(range(1, n + 1), lambda i: CAST((s + i * ((s - a + 20) % 20)) % 20 AS VARCHAR)), ','), '') AS truth FROM p),
  r AS (SELECT *, replace(truth, '1', '7') AS said FROM t), h AS (SELECT *, len(list_filter(range(1, len(truth) + 1), lambda i: left(said, i) = left(truth, i))) AS hits FROM r)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, prompt, truth, said, CAST(hits AS BIGINT) AS hits, round(hits / (len(truth) + 1), 6) AS reward FROM h""")
def shp_digit(spark, d):
    """Prompts from each line's numbers, their truths, and the dense rewards of answers with wrong digits."""
    key, a = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], F.col("l_partkey") % 21
    prompt = F.format_string("%d,%d:20,%d", a, (a + F.col("l_linenumber")) % 20, F.col("l_suppkey") % 6)
    x = table(spark, d, "lineitem").select(*key, prompt.alias("prompt")).withColumn("truth", R.digit_truth(F.col("prompt")))
    x = x.withColumn("said", F.replace("truth", F.lit("1"), F.lit("7"))).withColumn("rewards", R.digit_rewards(F.col("truth"), F.col("said")))
    return x.select(*key, "prompt", "truth", "said", F.size(F.filter("rewards", lambda r: r > 0)).cast("long").alias("hits"), r6(F.aggregate("rewards", F.lit(0.0), lambda a, b: a + b)).alias("reward"))


@query("shp_toolcall_parse", "SELECT event_id, event_id % 5 > 1 AS bad, CASE WHEN event_id % 5 <= 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 5 <= 1 THEN 1 + event_id % 5 ELSE 0 END::INTEGER AS n FROM events")
def shp_toolcall_parse(spark, d):
    """Objects (one with a nested value), a list, a text and what is no JSON."""
    k = F.col("event_id") % 5
    raw = F.when(k == 1, F.concat(F.lit('{"nested": {"x": [1]}, '), F.substring(F.col("props"), F.lit(2), F.length("props")))).when(k == 2, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 3, '"text"').when(k == 4, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    args, bad = R.call_arguments(raw)
    x = table(spark, d, "events").select("event_id", args.alias("args"), bad.alias("bad"))
    return x.select("event_id", "bad", F.try_variant_get(F.try_element_at("args", F.lit("k")), "$", "bigint").alias("k"), F.size("args").alias("n"))


@query("fn_zoom_calls", "SELECT id, CASE l_suppkey % 3 WHEN 0 THEN [gs, ps] WHEN 1 THEN [ps] ELSE [] END::DOUBLE[] AS starts, CASE l_suppkey % 3 WHEN 0 THEN [ge, pe] WHEN 1 THEN [pe] ELSE [] END::DOUBLE[] AS ends FROM spans", "spans")
def fn_zoom_calls(spark, d):
    """Two calls around bad ones, one over several lines, and none that can be read."""
    call = lambda a, b, gap="": F.concat(F.lit(f'<zoom>{gap}{{"start": '), F.col(a).cast("string"), F.lit(f', {gap}"end": '), F.col(b).cast("string"), F.lit(f"}}{gap}</zoom>"))
    k = F.col("l_suppkey") % 3
    t = F.when(k == 0, F.concat(call("gs", "ge"), F.lit('<zoom>{bad</zoom> and <zoom>{"start": "x", "end": 1}</zoom>'), call("ps", "pe"))).when(k == 1, call("ps", "pe", "\n")).otherwise('<zoom>{"start": 1}</zoom> <zoom>{"start": 1, "end": 2}')
    calls = T.zoom_calls(t)
    return V.spans(spark, d).select("id", F.transform(calls, lambda c: c["start"]).alias("starts"), F.transform(calls, lambda c: c["end"]).alias("ends"))


_MODELS = [("intfloat/E5-base", True), ("intfloat/e5-base", False), ("BAAI/bge-m3", True), ("BAAI/bge-m3", False), ("facebook/dpr", True)]


@query("ret_prefix", "WITH m AS (SELECT unnest([{'model': 'intfloat/E5-base', 'q': true, 'p': 'query: '}, {'model': 'intfloat/e5-base', 'q': false, 'p': 'passage: '}, {'model': 'BAAI/bge-m3', 'q': true, 'p': 'Represent this sentence for searching relevant passages: '}, {'model': 'BAAI/bge-m3', 'q': false, 'p': ''}, {'model': 'facebook/dpr', 'q': true, 'p': ''}]) AS m) SELECT doc_id, m.model AS model, m.q AS is_query, m.p || text AS t FROM documents, m")
def ret_prefix(spark, d):
    """Texts as five kinds of input."""
    docs = table(spark, d, "documents")
    parts = [docs.select("doc_id", F.lit(m).alias("model"), F.lit(q).alias("is_query"), S.prefixed(m, F.col("text"), q).alias("t")) for m, q in _MODELS]
    return B.concat(*parts)


@query("ret_pool", """WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS i FROM embeddings),
  m AS (SELECT label, i, sum(CASE WHEN vec_id % 3 <> 0 THEN v ELSE 0 END) / nullif(sum(CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END), 0) AS mean, arg_min(v, vec_id) AS cls, arg_max(v, vec_id) AS pooler FROM x GROUP BY label, i), s AS (SELECT 'dpr' AS kind, label, i, mean AS x FROM m WHERE false""" + "".join(f" UNION ALL SELECT '{n}', label, i, {c} AS x FROM m" for n, c in (("dpr", "mean"), ("mean", "mean"), ("cls", "cls"), ("pooler", "pooler"))) + """) SELECT kind, label, i::BIGINT AS i, round(CASE WHEN kind = 'dpr' THEN x ELSE x / greatest(sqrt(sum(x * x) OVER (PARTITION BY kind, label)), 1e-12) END, 6) + 0.0 AS x FROM s""")
def ret_pool(spark, d):
    """Vectors of a label as a sequence's tokens, the last one as its pooler's output."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("pos"), F.col("embedding").alias("v"), (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    last = e.groupBy("label").agg(F.max_by("v", "pos").alias("v"))
    parts = [S.pooled(e, how, model, by="label", pooler=last).select(F.lit(kind).alias("kind"), "label", F.col("i").cast("long").alias("i"), r6("x").alias("x")) for kind, how, model in (("dpr", "mean", "facebook/dpr"), ("mean", "mean", "e5"), ("cls", "cls", "e5"), ("pooler", "pooler", "e5"))]
    return B.concat(*parts)


@query("jn_doc_lookup", "WITH l AS (SELECT doc_id % 50 AS query, list(doc_id ORDER BY md5('5:' || doc_id)) AS ids FROM labels GROUP BY 1), e AS (SELECT query, unnest(ids) AS doc_id, generate_subscripts(ids, 1) AS rank FROM l) SELECT query, list(d.doc_id ORDER BY rank) AS ids, list(d.lang ORDER BY rank) AS langs FROM e JOIN documents d USING (doc_id) GROUP BY query")
def jn_doc_lookup(spark, d):
    """Documents of lists of ids, in the order of each list, which is not that of the ids."""
    ranked = F.sort_array(F.collect_list(F.struct(R.seeded(5, "doc_id").alias("k"), "doc_id")))
    lists = table(spark, d, "labels").groupBy((F.col("doc_id") % 50).alias("query")).agg(F.transform(ranked, lambda x: x["doc_id"]).alias("ids"))
    found = S.documents_of(lists, table(spark, d, "documents"), "query", "ids", "doc_id", ["doc_id", "lang"])
    return found.select("query", F.transform("found", lambda r: r["doc_id"]).alias("ids"), F.transform("found", lambda r: r["lang"]).alias("langs"))


_HITS = "CASE WHEN l_linenumber % 3 > 0 THEN list_transform(range(0, l_linenumber % 3), lambda i: 'T' || l_partkey || '-' || i || CASE WHEN i = 0 THEN chr(10) || 'about ' || l_suppkey ELSE '' END) ELSE [] END"
_TEXTED = "trim(array_to_string(list_transform(h, lambda x, i: 'Doc ' || i || ' (Title: ' || string_split(x, chr(10))[1] || ')' || chr(10) || substr(x, strpos(x || chr(10), chr(10)) + 1) || chr(10) || chr(10)), ''), ' ' || chr(10))"


@query("agg_search_meta", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_HITS} AS h FROM lineitem), q AS (SELECT l_orderkey, count(*) AS n, sum(len(h))::BIGINT AS total, string_agg({_TEXTED}, chr(10) || '---' || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM x GROUP BY 1),
  s AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN 'api_error' WHEN l_orderkey % 11 = 0 THEN 'unknown_api_state' WHEN l_orderkey % 5 = 0 THEN 'no_results' ELSE 'success' END AS status FROM q)
  SELECT l_orderkey, n::INTEGER AS query_count, status, CASE status WHEN 'success' THEN total ELSE 0 END::INTEGER AS total_results, CASE status WHEN 'success' THEN t END AS formatted_result, CASE status WHEN 'api_error' THEN 'Search error: code ' || l_orderkey WHEN 'unknown_api_state' THEN 'Unknown API state (no response and no error message).' WHEN 'no_results' THEN 'No search results found.' ELSE t END AS result FROM s""")
def agg_search_meta(spark, d):
    """An order's lines as a batch of searches: errors, no response, no results, and results with up to two passages for a query."""
    passages = F.transform(F.sequence(F.lit(0), (F.col("l_linenumber") % 3).cast("int")), lambda i: F.concat(F.lit("T"), F.col("l_partkey").cast("string"), F.lit("-"), i.cast("string"), F.when(i == 0, F.concat(F.lit("\nabout "), F.col("l_suppkey").cast("string"))).otherwise("")))
    passages = F.slice(passages, F.lit(1), (F.col("l_linenumber") % 3).cast("int"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", passages.alias("p"))))
    k = F.col("l_orderkey")
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("x"))
    error = F.when(k % 7 == 0, F.concat(F.lit("code "), k.cast("string")))
    results = F.when(k % 11 == 0, None).when(k % 5 == 0, F.array().cast("array<array<string>>")).otherwise(F.transform("x", lambda r: r["p"]))
    made = S.search_record(F.col("x"), error, results)
    return q.select("l_orderkey", *[made[c].alias(c) for c in ("query_count", "status", "total_results", "formatted_result")], F.from_json(made["result_text"], "result string")["result"].alias("result"))


@query("smp_modal", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders), b AS (SELECT block, row_number() OVER (ORDER BY md5('1:' || block), block) - 1 AS spot FROM (SELECT DISTINCT rn // 2 AS block FROM r WHERE rn < (SELECT count(*) // 2 * 2 FROM orders))) SELECT o_orderkey, spot * 2 + rn % 2 AS place FROM r JOIN b ON block = rn // 2")
def smp_modal(spark, d):
    """Blocks of two rows in a seeded order, order kept inside; a ragged tail is dropped."""
    r = B.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    size = 2
    whole = r.where(F.col("rn") < r.count() // size * size).withColumn("block", F.floor(F.col("rn") / size))
    blocks = whole.where(F.col("rn") % size == 0).select("block", R.seeded(1, "block").alias("key"))
    at = B.numbered(blocks, "key", "block", name="at").select("block", "at")
    return whole.join(at, "block").select("o_orderkey", (F.col("at") * size + F.col("rn") % size).alias("place"))


@query("agg_seqlen", "WITH p AS (SELECT uid % 8 AS part, sum(len)::BIGINT AS n FROM rollouts GROUP BY 1) SELECT min(n) AS low, max(n) AS high, max(n) - min(n) AS spread, round(avg(n), 6) AS mean FROM p", "rollouts")
def agg_seqlen(spark, d):
    """Spread of fixed parts; agg_seqlen_balance has that before and after balancing."""
    p = V.rollouts(spark, d).groupBy((F.col("uid") % 8).alias("part")).agg(F.sum("len").cast("long").alias("n"))
    return p.agg(F.min("n").alias("low"), F.max("n").alias("high"), (F.max("n") - F.min("n")).alias("spread"), r6(F.avg("n")).alias("mean"))
