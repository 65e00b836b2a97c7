"""The registered queries: one function `(spark, sf_dir) -> DataFrame` per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions import text as tx
from corpusq.functions import vectors as vx
from corpusq.functions.hooks import Sampling, default_classify, model_classify, model_embed, model_generate, model_tokens
from corpusq.operators import answers, cell_index, chunking, embedding, evaluation, graph, search
from corpusq.operators import sections as sec
from corpusq.operators.rowid import with_batches, with_row_id
from corpusq.plans import corpus, tables
from corpusq.plans.evaluation import evaluate_bank
from corpusq.session import materialize, scratch_path, spread
from corpusq.sources import chunk_store, readers, sinks, vector_table

TOPIC = "Contamination"
CELLS = 16
DOC_KEYS = ("doc_id", "split_id")


def _rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


# --- vectors ----------------------------------------------------------------


def vector_top2(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector of the table as a question against the whole table."""
    held = tables.vectors(spark, sf)
    asked = held.withColumnRenamed("id", "question_id")
    return search.top_k(asked, held, k=2).select("question_id", "rank", "id", *_rounded("score"))


def vector_top2_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same search with the question table cut into blocks, as large ones are."""
    held = tables.vectors(spark, sf)
    asked = held.withColumnRenamed("id", "question_id")
    return search.top_k(asked, held, k=2, broadcast_bytes=100_000).select("question_id", "rank", "id", *_rounded("score"))


def vector_top1_offset(spark: SparkSession, sf: str) -> DataFrame:
    held = tables.vectors(spark, sf)
    asked = held.withColumnRenamed("id", "question_id")
    return search.top_k(asked, held, k=1, offset=1).select("question_id", "rank", "id", *_rounded("score"))


def vector_top2_l2(spark: SparkSession, sf: str) -> DataFrame:
    held = tables.vectors(spark, sf)
    asked = held.withColumnRenamed("id", "question_id")
    return search.top_k(asked, held, k=2, metric="l2").select("question_id", "rank", "id", *_rounded("score"))


def vector_top2_by_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The exact search of larger question tables."""
    held = tables.vectors(spark, sf)
    asked = held.withColumnRenamed("id", "question_id")
    cells = search.build_cells(held, CELLS)
    return search.top_k_cells(asked, cells, k=2).select("question_id", "rank", "id", *_rounded("score"))


def _cell_index(spark: SparkSession, sf: str) -> cell_index.CellIndex:
    """A stored index whose cells are given: the first vectors of the table are the centroids."""
    held = tables.vectors(spark, sf)
    given = held.where(F.col("id") < CELLS).select(F.col("id").alias("cell"), F.col("embedding").alias("centroid"))
    return cell_index.create_index(held, scratch_path(spark, "cell-index"), centroids=given)


def vector_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate search on the stored index: the four nearest cells only."""
    asked = tables.vectors(spark, sf).withColumnRenamed("id", "question_id")
    found = cell_index.search_index(_cell_index(spark, sf), asked, k=2, n_probe=4)
    return found.select("question_id", "rank", "id", *_rounded("score"))


def vector_probe_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the exact hits that twelve cells of sixteen give, every fiftieth vector asked."""
    held = tables.vectors(spark, sf)
    asked = held.where(F.col("id") % 50 == 0).withColumnRenamed("id", "question_id")
    found = cell_index.search_index(_cell_index(spark, sf), asked, k=2, n_probe=12)
    return search.recall(found, search.top_k(asked, held, k=2)).select("expected", "found", *_rounded("recall"))


def vector_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine, Manhattan and Euclidean distance of each vector to the next one."""
    a = tables.vectors(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    return a.join(b, "id").select(
        "id",
        F.round(vx.cosine(x, y), 6).alias("cosine"),
        F.round(vx.manhattan(x, y), 6).alias("manhattan"),
        F.round(vx.euclid(x, y), 6).alias("euclid"),
    )


def vector_predicate_scan(spark: SparkSession, sf: str) -> DataFrame:
    held = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    found = embedding.predicate_scan(held, "id > 1", ["id", "label", "embedding"], 1, ["id"])
    return found.select("id", "label", F.round(vx.norm(F.col("embedding")), 6).alias("length"))


def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Default vectors of the questions, as scaled whole numbers in one text."""
    cells = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string"))
    return tables.questions(spark, sf).select("question_id", F.array_join(cells, ",").alias("embedding"))


# --- chunks -----------------------------------------------------------------


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select("doc_id", F.col("text").alias("content"), "lang")


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_texts(spark, sf)).select("doc_id", "split_id", "split", "tokens")


def chunk_documents_no_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of five sentences of every text, English and French ones only."""
    rows = chunking.chunk(_texts(spark, sf), split_length=5, max_tokens=None, lang="lang", valid_languages=("en", "fr"))
    return rows.drop("content").select("doc_id", "split_id", "split", "tokens")


def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.chunk(_texts(spark, sf), split_by="word", split_length=100, max_tokens=None)
    return rows.select("doc_id", "split_id", "split", "tokens")


def numeric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a line of numbers in front and one at the end."""
    texts = spread(tables.table(spark, sf, "documents"))
    digits = F.concat_ws(" ", F.col("n_chars").cast("string"), F.lit("chars"), F.col("doc_id").cast("string"))
    text = F.concat(digits, F.lit("\n"), "text", F.lit("\n"), digits, F.lit("."))
    return texts.select("doc_id", tx.clean(tx.drop_numeric_lines(text)).alias("cleaned"))


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sections numbered over the whole table, then cut."""
    parsed = sec.parse_sections(tables.contents(spark, sf), exclude=tables.LEFT_OUT)
    numbered = with_row_id(parsed, ["page_id", "section_no"])
    return chunking.chunk(numbered).select(
        "id", "page_id", "title", "section", "subsection", "split", "split_id", "tokens"
    )


def token_histogram(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluation.histogram(tables.document_chunks(spark, sf), "tokens", bins="auto")
    return found.select("bin", *_rounded("low", "high"), "n")


def chunk_size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts for chunks of one to seven sentences and, as size 0, of the final ones under the token limit, side by side."""
    rows = chunking.chunk_sizes(_texts(spark, sf), range(1, 8)).select("split_length", "tokens")
    final = chunking.chunk(_texts(spark, sf)).select(F.lit(0).alias("split_length"), "tokens")
    rows = rows.unionByName(final)
    return evaluation.histogram(rows, "tokens", bins=20, by="split_length").select(
        "split_length", "bin", *_rounded("low", "high"), "n"
    )


def token_density(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.document_chunks(spark, sf)
    return evaluation.density(rows, "tokens", [float(p) for p in range(0, 520, 20)], bandwidth=15.0).select(
        "point", F.round("density", 9).alias("density")
    )


def token_density_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Over the range of the data, bandwidth by Scott's rule."""
    found = evaluation.density(tables.document_chunks(spark, sf), "tokens", points=50)
    return found.select(*_rounded("point"), F.round("density", 9).alias("density"))


# --- sections ---------------------------------------------------------------


def sections_from_markup(spark: SparkSession, sf: str) -> DataFrame:
    return sec.parse_sections(tables.contents(spark, sf), exclude=tables.LEFT_OUT)


def sections_from_web_pages(spark: SparkSession, sf: str) -> DataFrame:
    return sec.parse_sections(tables.web_contents(spark, sf))


def revision_bounds(spark: SparkSession, sf: str) -> DataFrame:
    pages = tables.contents(spark, sf).select("page_id", "title")
    return sec.with_revision_times(pages, sec.revision_bounds(tables.revisions(spark, sf)))


def _revision_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Events as saved responses: two revisions each, newest first."""

    def iso(ts: Column) -> Column:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    stamps = [F.struct(iso(F.col("ts")).alias("timestamp")), F.struct(iso(F.date_trunc("DAY", "ts")).alias("timestamp"))]
    page = F.create_map(F.col("user_id").cast("string"), F.struct(F.array(*stamps).alias("revisions")))
    response = F.to_json(F.struct(F.struct(page.alias("pages")).alias("query")))
    return tables.table(spark, sf, "events").select("event_id", F.col("user_id").alias("page_id"), response.alias("response"))


def revision_json(spark: SparkSession, sf: str) -> DataFrame:
    """Times by position inside a response, then over all responses of a page."""
    times = readers.revision_times(_revision_responses(spark, sf), "response")
    return times.groupBy("page_id").agg(
        F.min("creation_date").alias("creation_date"), F.max("last_modified").alias("last_modified"),
        F.count("*").alias("responses"),
    )


def revision_row_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return sec.revision_bounds(readers.revision_rows(_revision_responses(spark, sf), "response"))


# --- graph ------------------------------------------------------------------


def graph_store(spark: SparkSession, sf: str) -> DataFrame:
    """The stored graph: rows of its tables. The other graph queries read the store that is there."""
    store = tables.graph_store(spark, sf)
    parts = {
        "terms": store.terms(), "concepts": store.concepts(), "labels": store.labels(), "broader": store.broader(),
        "subject": store.subjects(), "urls": store.page_urls(), "page_ids": store.page_ids(),
    }
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts.items()]
    result = counted[0]
    for more in counted[1:]:
        result = result.unionByName(more)
    return result


def concept_search_id(spark: SparkSession, sf: str) -> DataFrame:
    return graph.concept_search(tables.graph_store(spark, sf), "Category:")


def concept_search_label(spark: SparkSession, sf: str) -> DataFrame:
    words = tables.rare_words(spark, sf)
    return graph.concept_search(tables.graph_store(spark, sf), "e", mode="label", stop_words=words)



def concept_search_rare(spark: SparkSession, sf: str) -> DataFrame:
    """A longer term: only labels with its rarest grams are looked at."""
    return graph.concept_search(tables.graph_store(spark, sf), "ation", mode="label", stop_words=tables.rare_words(spark, sf))


def empty_term(spark: SparkSession, sf: str) -> DataFrame:
    """How many concepts are found without a term, and with one."""
    store = tables.graph_store(spark, sf)
    counted = [
        graph.concept_search(store, term, min_children=0).agg(F.count("*").alias("n")).select(F.lit(name).alias("term"), "n")
        for name, term in (("empty", ""), ("null", None), ("given", "Category:"))
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def inline_narrower(spark: SparkSession, sf: str) -> DataFrame:
    """Children of categories that are given in the call, each with its level."""
    given = graph.inline(spark, [("Category:NATION_1", 0), ("Category:NATION_2", 1), ("Category:none", 2)], "parent string, level int")
    found = graph.narrower(tables.graph_store(spark, sf), given.select("parent")).drop("level")
    return found.join(F.broadcast(given), "parent").select("level", "parent", "child")  # three rows


def concept_options(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.concept_search(tables.graph_store(spark, sf), "Category:")
    return sinks.option_records(graph.options(found, by_text=True))


def stop_word_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Labels without stop words, the list joined as long lists are."""
    named = graph.labels(tables.triples(spark, sf)).where("lang = 'en'")
    return graph.without_stop_words(named, "label", tables.rare_words(spark, sf), literal_words=0).select("id", "label")


def narrower(spark: SparkSession, sf: str) -> DataFrame:
    """Children of every nation."""
    nations = tables.table(spark, sf, "nation").select(F.concat(F.lit("Category:"), "n_name").alias("parent"))
    found = graph.narrower(tables.graph_store(spark, sf), nations, 0, tables.rare_words(spark, sf))
    return found.withColumn("name", tx.after_last_colon(F.col("child")))


def expand(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.expand(
        tables.graph_store(spark, sf), tables.roots(spark, sf), depth=4, stop_words=tables.rare_words(spark, sf)
    )
    return found.withColumn("name", tx.category_name(F.col("category")))


def expand_all_paths(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand_paths(tables.graph_store(spark, sf), tables.roots(spark, sf), depth=3)


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "customer").select(F.concat(F.lit("Category:"), "c_name").alias("category"))


def category_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of all categories two and three levels below the roots."""
    store = tables.graph_store(spark, sf)
    found = graph.expand(store, tables.roots(spark, sf), depth=3, named=False)
    return graph.category_pages(store, found.select("category"), named=False)


def category_pages_batched(spark: SparkSession, sf: str) -> DataFrame:
    parts = tables.table(spark, sf, "part").select(
        F.concat(F.lit("Category:Part "), F.col("p_partkey").cast("string")).alias("category")
    )
    found = graph.category_pages(tables.graph_store(spark, sf), parts, per_batch=True)
    return found.groupBy("page_url", "page_id").agg(F.count("*").alias("batches"))


def category_batches(spark: SparkSession, sf: str) -> DataFrame:
    quoted = _customers(spark, sf).withColumn("quoted", tx.percent_encode(F.col("category")))
    return with_batches(quoted, ["category"], graph.CATEGORIES_PER_BATCH)


def sparql_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """Saved responses of the narrower query, one per customer."""
    rows = tables.table(spark, sf, "customer")

    def value(c: Column) -> Column:
        return F.struct(c.cast("string").alias("value"))

    binding = F.struct(
        value(F.concat(F.lit("Category:NATION_"), F.col("c_nationkey").cast("string"))).alias("r"),
        value(F.concat(F.lit("Category:"), "c_name")).alias("c1"),
        value(F.lit(0)).alias("level"),
    )
    response = F.to_json(F.struct(F.struct(F.array(binding, binding).alias("bindings")).alias("results")))
    responses = rows.select("c_custkey", response.alias("response"))
    found = readers.bindings(responses, "response", "level", "r", "c1").distinct()
    return found.select("c_custkey", "level", "r", tx.after_last_colon(F.col("c1")).alias("name"))


def stopword_add_delete(spark: SparkSession, sf: str) -> DataFrame:
    words = tables.part_words(spark, sf).distinct()
    segments = tables.table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("word")).distinct()
    types = tables.table(spark, sf, "part").select(F.lower("p_type").alias("word")).distinct()
    return sinks.delete_stop_words(sinks.add_stop_words(words, segments), types)


# --- corpus -----------------------------------------------------------------


def _corpus_sections(spark: SparkSession, sf: str) -> DataFrame:
    pages = corpus.selected_pages(
        tables.graph_store(spark, sf), tables.roots(spark, sf), 3, tables.page_texts(spark, sf),
        sec.revision_bounds(tables.revisions(spark, sf)), prepare=tables.marked,
    )
    return corpus.sections(pages, tables.LEFT_OUT)


def corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    """Roots to categories, pages, sections, chunks and vectors with metadata."""
    built = corpus.vectors(corpus.chunks(_corpus_sections(spark, sf)))
    fields = [embedding.metadata_field(f).alias(f) for f in ("page_url", "title", "section", "subsection", "split")]
    times = [
        embedding.metadata_field(f).cast("timestamp_ntz").alias(f) for f in ("creation_date", "last_modified")
    ]
    tokens = embedding.metadata_field("tokens").cast("int").alias("tokens")
    size = F.round(vx.norm(F.col("embedding")), 5).alias("length")
    return built.select("page_id", "section_no", "split_id", *fields, *times, tokens, size)


def metadata_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Partial labels joined to documents, nulls filled in the metadata."""
    joined = tables.documents(spark, sf).join(tables.table(spark, sf, "labels"), "doc_id", "left")
    built = embedding.with_metadata(joined, ["doc_id", "source", "lang", "quality", "toxic"])
    return built.select(
        "doc_id", *[embedding.metadata_field(f).alias(f) for f in ("source", "lang", "quality", "toxic")]
    )


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Sections written as CSV and read back."""
    path = scratch_path(spark, "csv")
    rows = sec.parse_sections(tables.contents(spark, sf), exclude=tables.LEFT_OUT)
    sinks.write_csv(rows.select("page_id", "title", "section_no", "section", "subsection", "content"), path)
    return readers.read_csv(
        spark, path, "page_id bigint, title string, section_no int, section string, subsection string, content string"
    )


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bank")
    bank = tables.turn_pairs(spark, sf).select("conv_id", "turn", "question", F.col("reply").alias("answer"))
    bank.write.json(path)
    return readers.read_records(spark, path, "conv_id bigint, turn bigint, " + readers.QUESTION_SCHEMA, lines=True)


def vector_append(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors appended twice by key: the second run finds nothing new."""
    path = scratch_path(spark, "vectors")
    rows = tables.vectors(spark, sf)
    sinks.append_vectors(rows, path, dedupe_key=["id"], dim=64)
    sinks.append_vectors(rows, path, dedupe_key=["id"], dim=64)
    return readers.read_vectors(spark, path).select("id", F.round(vx.norm(F.col("embedding")), 6).alias("length"))


def vector_append_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of pages with repeated headings, loaded in two batches that overlap, the second one twice."""
    path = scratch_path(spark, "chunk-vectors")
    parsed = sec.parse_sections(tables.contents(spark, sf), exclude=tables.LEFT_OUT)
    rows = embedding.embed(chunking.chunk(parsed).drop("content"), "split")
    vector_table.load_batch(rows.where("page_id % 3 <> 0"), path, "first", buckets=8, dim=64)
    for _ in range(2):
        vector_table.load_batch(rows, path, "second", buckets=8, dim=64)
    return vector_table.read_rows(spark, path).select("page_id", "section_no", "split_id", "section", "tokens", "batch_id")


def vector_table_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """A table made twice, filled, read and dropped."""
    folder = scratch_path(spark, "tables")
    database = "corpusq_" + folder.rpartition("-")[2]
    name = f"{database}.vectors"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    for _ in range(2):
        sinks.create_vector_table(spark, name)
    tables.vectors(spark, sf).select("id", "embedding", F.lit("{}").alias("metadata")).write.insertInto(name)
    held = materialize(readers.read_vectors(spark, name).select("id", F.round(vx.norm(F.col("embedding")), 6).alias("length")), "held")
    sinks.drop_vector_table(spark, name)
    gone = not spark.catalog.tableExists(name)
    spark.sql(f"DROP DATABASE {database}")
    return held.withColumn("dropped", F.lit(gone))


def json_array_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The bank as record arrays, one file for fifty conversations."""
    path = scratch_path(spark, "arrays")
    bank = tables.turn_pairs(spark, sf).select("conv_id", "turn", "question", F.col("reply").alias("answer"))
    sinks.write_records(bank, path, F.floor(F.col("conv_id") / 50))
    return readers.read_records(spark, path, "conv_id bigint, turn bigint, " + readers.QUESTION_SCHEMA)


def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as files of a folder, read whole; the first of them also by itself."""
    path = scratch_path(spark, "texts")
    sinks.write_texts(tables.table(spark, sf, "benchmark"), path, "item_id", "text")
    number = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint")
    every = readers.read_texts(spark, path).select(number.alias("item_id"), "content")
    first = every.agg(F.min("item_id")).first()[0]
    alone = readers.read_texts(spark, f"{path}/item_id={first}").select(number.alias("item_id"), F.col("content").alias("alone"))
    return every.join(F.broadcast(alone), "item_id", "left")  # one row


def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and responses that give nothing, with the reason."""
    kind = F.col("doc_id") % 10
    text = F.when(kind == 1, F.lit(" \n ")).when(kind != 0, F.col("content"))
    texts = chunking.rejected(_texts(spark, sf).withColumn("content", text)).select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), "reason")
    responses = _revision_responses(spark, sf)
    place = F.col("event_id") % 10
    spoiled = F.when(place == 0, F.lit("<html>")).when(place == 1, F.lit('{"query":{"pages":{}}}')).otherwise(F.col("response"))
    other = readers.rejected_responses(responses.withColumn("response", spoiled), "response")
    return texts.unionByName(other.select(F.lit("response").alias("kind"), F.col("event_id").alias("id"), "reason"))


def row_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Single rows and single cells by key."""
    held = tables.table(spark, sf, "documents")
    row = held.where(F.col("doc_id") == 7).select("doc_id", "source", "lang")
    cell = held.where(F.col("doc_id") == 42).select("doc_id", F.lit(None).cast("string").alias("source"), "lang")
    return row.unionByName(cell)


def metadata_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata whose fields differ from row to row, stored as a variant; only the asked fields are taken out."""
    joined = tables.documents(spark, sf).join(tables.table(spark, sf, "labels"), "doc_id", "left")
    built = embedding.open_metadata(joined, ["source", "lang", "quality", "toxic", "text"]).select("doc_id", "metadata")
    held = materialize(built, "variants")
    return held.select(
        "doc_id", embedding.variant_field("source").alias("source"), embedding.variant_field("quality", "int").alias("quality"),
        embedding.variant_field("toxic", "int").alias("toxic"), embedding.variant_field("absent").alias("absent"),
    )


def _text_lengths():
    """A stand-in for a model: three numbers of a text."""
    return lambda texts: [[float(len(t)), float(t.count("a")), float(t.count("e"))] for t in texts]


def _quarters():
    return lambda texts: [len(t) // 4 for t in texts]


def _by_length():
    return lambda texts: ["long" if len(t) > 300 else "short" for t in texts]


def _first_characters():
    return lambda prompts, max_tokens, top_k, **rest: [f"{p[:max_tokens]}|{top_k}" for p in prompts]


def model_hooks(spark: SparkSession, sf: str) -> DataFrame:
    """All four hooks with models of their own, each loaded once for each worker."""
    text = F.col("text")
    values = F.array_join(F.transform(model_embed(_text_lengths)(text), lambda x: x.cast("int").cast("string")), ",")
    generate = model_generate(_first_characters, Sampling(max_tokens=12, top_k=7))
    return tables.table(spark, sf, "conversations").select(
        "conv_id", "turn", values.alias("embedding"), model_tokens(_quarters)(text).alias("tokens"),
        model_classify(_by_length)(text).alias("label"), generate(text, F.lit("")).alias("generated"),
    )


def vector_append_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Without a key a second run adds the rows again."""
    path = scratch_path(spark, "vectors")
    rows = tables.vectors(spark, sf)
    sinks.append_vectors(rows, path)
    sinks.append_vectors(rows, path)
    return readers.read_vectors(spark, path).groupBy("id").agg(F.count("*").alias("copies"))


# --- answers ----------------------------------------------------------------


def _retrieved(spark: SparkSession, sf: str, sep: str = answers.SERVICE_SEPARATOR) -> DataFrame:
    """Search over all chunks; then only documents with hits are cut again for
    their texts."""
    asked = tables.questions(spark, sf)
    small = search.fits_broadcast(asked)
    hits = materialize(
        search.top_k(asked, tables.chunk_vectors(spark, sf), answers.HITS, keys=DOC_KEYS, small=small), "hits"
    )
    return answers.gather(asked, hits, tables.document_chunks(spark, sf, only=hits), small, sep, DOC_KEYS)


def chunk_top2(spark: SparkSession, sf: str) -> DataFrame:
    """The two nearest chunks of every question, by key only."""
    hits = search.top_k(tables.questions(spark, sf), tables.chunk_vectors(spark, sf), k=2, keys=DOC_KEYS)
    return hits.select("question_id", "rank", *DOC_KEYS, *_rounded("score"))


def retrieve_context(spark: SparkSession, sf: str) -> DataFrame:
    found = _retrieved(spark, sf, answers.EVALUATION_SEPARATOR)
    return found.select("question_id", "question", "context")


def retrieve_best(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf).select("question_id", "best")


def retrieve_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Question to answer record: vectors, two nearest chunks, prompt, model
    hook, extraction, JSON."""
    return sinks.answer_records(answers.answer(_retrieved(spark, sf), TOPIC))


def retrieve_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers from chunks at rest, vectors and texts in tables of equal buckets."""
    path = scratch_path(spark, "chunk-store")
    rows = embedding.embed(tables.document_chunks(spark, sf))
    store = chunk_store.write_chunk_store(rows, "corpusq_" + path.rpartition("-")[2], path, DOC_KEYS)
    found = materialize(chunk_store.retrieve_stored(tables.questions(spark, sf), store), "stored-answers")
    chunk_store.drop_chunk_store(spark, store)
    return sinks.answer_records(answers.answer(found, TOPIC))


def evaluation_run(spark: SparkSession, sf: str) -> DataFrame:
    found = _retrieved(spark, sf, answers.EVALUATION_SEPARATOR)
    return evaluate_bank(tables.questions(spark, sf), found, TOPIC)


def evaluation_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunk alone as context, under the prompt that asks for help."""
    template = answers.instruction_prompt("helpful")
    return evaluate_bank(tables.questions(spark, sf), _retrieved(spark, sf), TOPIC, best_only=True, template=template)


def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    pairs = tables.turn_pairs(spark, sf).withColumn("context", F.col("reply"))
    first = answers.with_prompt(pairs, TOPIC)
    second = answers.with_prompt(pairs, TOPIC, answers.ROLE_PROMPT).select(
        "conv_id", "turn", F.col("prompt").alias("role_prompt")
    )
    return first.select("conv_id", "turn", "prompt").join(second, ["conv_id", "turn"])


def answer_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Answers cut from echoed prompts, by marker, by pattern, and without a marker."""
    pairs = tables.turn_pairs(spark, sf).withColumn("context", F.lit("none"))
    echoed = F.concat("prompt", F.lit("\n "), "reply")
    instruct = answers.with_prompt(pairs, TOPIC).withColumn("raw", echoed)
    roles = answers.with_prompt(pairs, TOPIC, answers.ROLE_PROMPT).withColumn("raw", echoed)
    cut = instruct.select(
        "conv_id", "turn",
        tx.answer_after(F.col("raw")).alias("by_mark"),
        tx.answer_matched(F.col("raw")).alias("by_pattern"),
        tx.answer_after(F.col("reply")).alias("no_mark"),
        tx.answer_matched(F.col("reply")).alias("no_pattern"),
    )
    other = roles.select("conv_id", "turn", tx.answer_after(F.col("raw"), tx.ASSISTANT_MARK).alias("by_role"))
    return cut.join(other, ["conv_id", "turn"])


def answer_display(spark: SparkSession, sf: str) -> DataFrame:
    """Turns escaped the way a JSON encoder escapes them, then shown."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    for letter, code in (("é", "\\u00e9"), ("ç", "\\u00e7"), ("ß", "\\u00df"), ("ñ", "\\u00f1")):
        text = F.replace(text, F.lit(letter), F.lit(code))
    raw = F.concat(F.lit('"'), text, F.lit(' said "so" \\t"'))
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", tx.display(raw).alias("shown"))


def legacy_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata kept as the text of a dict, with `nan` for missing labels."""
    joined = tables.documents(spark, sf).join(tables.table(spark, sf, "labels"), "doc_id", "left")
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("nan"))
    toxic = F.coalesce(F.col("toxic").cast("string"), F.lit("None"))
    saved = F.concat(
        F.lit("{'doc_id': "), F.col("doc_id").cast("string"), F.lit(", 'split': '"), F.col("source"),
        F.lit(" nan', 'quality': "), quality, F.lit(", 'toxic': "), toxic, F.lit("}"),
    )
    parsed = tx.legacy_record(saved, "doc_id bigint, split string, quality int, toxic int")
    return joined.select(parsed.alias("m")).select("m.doc_id", "m.split", "m.quality", "m.toxic")


def question_label(spark: SparkSession, sf: str) -> DataFrame:
    """Class of every turn, and of the turn with a question mark."""
    talk = tables.table(spark, sf, "conversations")
    return talk.select(
        "conv_id", "turn", default_classify(F.col("text")).alias("label"),
        default_classify(F.concat("text", F.lit(" ?"))).alias("asked_label"),
    )


# --- evaluation -------------------------------------------------------------


def _pair_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """User turn, reply, and the turn after the reply, as vectors. Turns are embedded once and stored for the joins."""
    talk = embedding.embed(spread(tables.table(spark, sf, "conversations")), "text").select("conv_id", "turn", "role", "embedding")
    talk = materialize(talk, "turn-vectors")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("embedding").alias("q"))
    a = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("embedding").alias("a"))
    b = talk.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("embedding").alias("b"))
    return asked.join(a, ["conv_id", "turn"]).join(b, ["conv_id", "turn"])


def pair_eval(spark: SparkSession, sf: str) -> DataFrame:
    names = ("cosine_similarity", "manhattan_distance", "cosine_similarity_question_a", "cosine_similarity_question_b")
    scored = evaluation.pair_scores(_pair_vectors(spark, sf), "a", "b", "q", manhattan=True)
    return scored.select("conv_id", "turn", *_rounded(*names))


def score_stats(spark: SparkSession, sf: str) -> DataFrame:
    scored = evaluation.pair_scores(_pair_vectors(spark, sf), "a", "b", "q")
    stats = evaluation.score_stats(scored, "cosine_similarity_question_a", "cosine_similarity_question_b")
    return stats.select("column", *_rounded("min", "max", "mean"), "n")


def cosine_histogram(spark: SparkSession, sf: str) -> DataFrame:
    a = tables.vectors(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    scored = a.join(b, "id").select(F.round(vx.cosine(F.col("embedding"), F.col("other")), 9).alias("score"))
    return evaluation.histogram(scored, "score", bins=20).select("bin", *_rounded("low", "high"), "n")


def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the vector table, the chunks and the question bank."""
    counted = [
        tables.table(spark, sf, "embeddings").agg(F.count("*").alias("n")).withColumn("name", F.lit("vectors")),
        tables.document_chunks(spark, sf).agg(F.count("*").alias("n")).withColumn("name", F.lit("chunks")),
        tables.table(spark, sf, "benchmark").agg(F.count("*").alias("n")).withColumn("name", F.lit("questions")),
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).select("name", "n")


QUERIES = {
    f.__name__: f
    for f in (
        vector_top2, vector_top2_blocks, vector_top1_offset, vector_top2_l2, vector_top2_by_cells, vector_topk_cells, vector_probe_recall, vector_distances,
        vector_predicate_scan, text_vectors, chunk_documents, chunk_documents_no_limit, chunk_words, numeric_lines,
        chunk_rows, token_histogram, chunk_size_histogram, token_density,
        token_density_by_rule, sections_from_markup,
        sections_from_web_pages, revision_bounds, revision_json, revision_row_bounds, graph_store, concept_search_id,
        concept_search_label, concept_search_rare, empty_term, concept_options, stop_word_filter, narrower, inline_narrower, expand,
        expand_all_paths, category_pages, category_pages_batched, category_batches, sparql_bindings,
        stopword_add_delete, corpus_build, metadata_fill, metadata_variant, csv_roundtrip, json_roundtrip,
        json_array_roundtrip, text_files, rejected_rows, row_lookup, model_hooks, vector_append, vector_append_chunks,
        vector_table_lifecycle, vector_append_plain, chunk_top2, retrieve_context, retrieve_best, retrieve_answers, retrieve_stored, evaluation_run, evaluation_best,
        prompt_build, answer_extract, answer_display, legacy_metadata, question_label, pair_eval, score_stats,
        cosine_histogram, row_counts,
    )
}
