"""The engine: an index of a source tree as tables, kept up to date; local answers to questions; packed context for prompts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import code
from cairn.operators import embedding as E
from cairn.operators import relational as R
from cairn.operators import retrieval as H
from cairn.operators import search as S
from cairn.plans import planner, prompts, verifier
from cairn.plans.store import Store
from cairn.sources import files as sources

TABLES = ("files", "symbols", "edges", "chunks", "embeddings")
#: What the tables were made by; another number here makes the next index a full one.
VERSIONS = {"schema": 3, "parser": 2, "tagger": 1, "chunker": 1, "embedding": 1, "postings": 1}
QUEUE = "path string, event_type string, priority int, created_at timestamp, status string, processed_at timestamp, claimed_at timestamp"
# Priorities of changes, the most rows of an answer, tags and edges behind handlers, types that a summary counts.
USER, GIT, HASH_SCAN = 30, 20, 10
LIMITS = {"where_is": 50, "which_package": 20, "find_symbol": 20}
LIST_LIMIT = 500
_TAGS = {"controllers": "controller", "services": "service", "repositories": "repository", "components": "component"}
_EDGES = {"routes": "routes_to", "implements": "implements", "extends": "extends"}
_TYPES = ("class", "interface", "enum")
_TAG_HANDLERS = {*_TAGS, "grouped_routes"}


@dataclass
class Answer:
    """Context for a prompt; at most a few dozen rows come to the driver."""

    prompt: str
    intent: str
    chunks: list[dict]
    dependencies: dict[str, list[str]]
    confidence: float
    confidence_reason: str
    repo_tokens: int
    context_tokens: int
    reduction: float
    warnings: list[str] = field(default_factory=list)
    diff: str = ""
    logs: list[str] = field(default_factory=list)
    explanation: str | None = None

    @property
    def files(self) -> dict[str, str]:
        """Path and first reason of each file, in order."""
        out: dict[str, str] = {}
        for c in self.chunks:
            out.setdefault(c["path"], "; ".join(c["reasons"]) or c["source"])
        return out

    @property
    def symbols(self) -> list[dict]:
        """Each symbol of a file once, in order."""
        out: dict[tuple, dict] = {}
        for c in self.chunks:
            if c["symbol"]:
                out.setdefault((c["path"], c["symbol"]), {k: c[k] for k in ("symbol", "kind", "path", "start_line", "end_line")})
        return list(out.values())

    def to_json(self) -> str:
        """Names in camel case."""
        camel = lambda k: k.split("_")[0] + "".join(w.title() for w in k.split("_")[1:])
        turned = lambda v: {camel(k): turned(x) for k, x in v.items()} if isinstance(v, dict) else [turned(x) for x in v] if isinstance(v, list) else v
        return json.dumps(turned(asdict(self) | {"relevant_files": [{"path": p, "reason": r} for p, r in self.files.items()], "target_symbols": self.symbols}), default=str)


class Engine:
    """Tables live under `home`; a handler is a function of (engine, question) to a DataFrame."""

    def __init__(self, spark: SparkSession, home: str, settings: dict | None = None, embedder: E.Embedder | None = None):
        self.settings = sources.merged_settings(sources.DEFAULTS, settings or {})
        self.spark, self.store, self.handlers = spark, Store(spark, home, self.settings["indexing"]["buckets"]), {}
        self.embedder = embedder or E.embedder(self.settings["embedding"]["provider"])
        self.resolvers: list[Callable[[prompts.Prompt, DataFrame, DataFrame], list[DataFrame]]] = [H.resolved]

    # The index

    def stale(self) -> list[str]:
        """Parts of an existing index that another version made."""
        then = self.store.state.get("versions")
        return [] if then is None else [k for k, v in VERSIONS.items() if then.get(k) != v]

    def index(self, root: str, force: bool = False) -> dict[str, int]:
        """Brings the index in line with the tree: new and changed files are parsed, unchanged ones are left, lost ones marked as
        deleted with all that hangs on them. Everything is made anew with `force` or where a part is stale. Returns counts."""
        mark = self.store.staged()
        found, scanned = self.store.counted("scanned", sources.scan(self.spark, root))
        known = self.store.has("files")
        force = force or not known or bool(self.stale())
        live = self.table("files") if known else found.filter("false")
        new = found if force else R.changed(found, live, "path", "file_hash")
        gone = R.without(live.select("path"), found.select("path"), "path")
        counts = self._apply(root, new, gone, anew=force)
        self.store.release(mark)
        return {"scanned": scanned, **counts}

    def reindex(self, root: str, changed: list[str], gone: list[str]) -> dict[str, int]:
        """Parses the changed files again, whatever their hash, and marks gone ones, and changed ones that aren't there, as deleted."""
        mark = self.store.staged()
        new = self.store.stage("scanned", sources.scan(self.spark, root, paths=changed))
        lost = self.spark.createDataFrame([(x,) for x in [*changed, *gone]], "path string")
        counts = self._apply(root, new, R.without(lost, new.select("path"), "path"), anew=False)
        self.store.release(mark)
        return counts

    def _apply(self, root: str, new: DataFrame, gone: DataFrame, anew: bool) -> dict[str, int]:
        """Writes the buckets that new and lost files lie in; all of them with `anew`. Each stage counts itself as it is written."""
        known = self.store.has("files")
        new, n_new = self.store.counted("new_files", new)
        gone, n_gone = self.store.counted("gone", gone.distinct())
        symbols, n_symbols = self.store.counted("new_symbols", code.tagged(code.symbols(new)))
        edges = code.edges(symbols)
        chunks, n_chunks = self.store.counted("new_chunks", code.chunks(new, symbols, most=self.settings["embedding"]["max_chunk_tokens"]))
        touched = new.select("path").unionByName(gone).distinct()
        hit = None if anew else self.store.buckets_of(touched)

        def kept(name: str, now: DataFrame) -> DataFrame:
            return R.without(self.store.read(name, hit), touched, "path").unionByName(now, allowMissingColumns=True) if known else now

        indexed = new.withColumns({"indexed_at": F.current_timestamp(), "is_deleted": F.lit(False)})
        if known:
            dead = self.store.read("files", hit).join(gone, "path", "left_semi").withColumns({"is_deleted": F.lit(True), "text": F.lit(None).cast("string")})
            indexed = indexed.unionByName(dead, allowMissingColumns=True)
        all_chunks = self.store.stage("chunks", kept("chunks", chunks))
        vectors = self._vectors(all_chunks, hit, reuse=known and not anew)
        tables = {"files": kept("files", indexed), "symbols": kept("symbols", symbols), "edges": kept("edges", edges), "chunks": all_chunks, "embeddings": vectors, "postings": kept("postings", S.postings(chunks, "path"))}
        now = datetime.now(UTC).isoformat()
        if hit != []:
            self.store.commit(tables, hit, {"postings": "gram", "chunks": "chunk_id"}, versions=VERSIONS, root=root, branch=sources.git_branch(root), **{"full_index_at" if anew else "incremental_index_at": now})
        return {"indexed": n_new, "deleted": n_gone, "symbols": n_symbols, "chunks": n_chunks}

    def _vectors(self, chunks: DataFrame, hit: list[int] | None, reuse: bool) -> DataFrame:
        """A vector for each chunk: the one at hand where its content is the same, else a new one; none without a chunk."""
        rows = chunks.select("chunk_id", "path", "content_hash", "content")
        columns = ["chunk_id", "path", "content_hash", "vector"]
        if not reuse:
            return self.embedder(rows.select("chunk_id", "content")).join(rows.drop("content"), "chunk_id").select(*columns)
        old = self.store.read("embeddings", hit).join(rows.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi").select(*columns)
        fresh = self.store.stage("fresh", rows.join(old.select("chunk_id"), "chunk_id", "left_anti"))
        return old.unionByName(self.embedder(fresh.select("chunk_id", "content")).join(fresh.drop("content"), "chunk_id").select(*columns))

    def table(self, name: str) -> DataFrame:
        """A table; of files those that aren't deleted."""
        found = self.store.read(name)
        return found.filter("not is_deleted").drop("is_deleted") if name == "files" else found

    # The change queue

    def _queue(self) -> DataFrame:
        return self.store.read("queue") if self.store.has("queue") else self.spark.createDataFrame([], QUEUE)

    def enqueue(self, root: str, paths: list[str], event_type: str = "modified", priority: int = USER) -> int:
        """Adds changes below root of files that an index holds; returns how many. One row a path: latest event, greatest priority."""
        inside = [p for p in map(lambda x: sources.below(root, x), paths) if p]
        given = self.spark.createDataFrame([(p,) for p in dict.fromkeys(inside)], "path string")
        now = given.select("path", F.lit(event_type).alias("event_type"), F.lit(priority).alias("priority"), F.current_timestamp().alias("created_at"), F.lit(1).cast("long").alias("id"))
        return self.enqueue_rows(now)

    def enqueue_rows(self, events: DataFrame) -> int:
        """Adds events (path below root, event_type, priority, created_at, id), of which only the buckets they lie in are written."""
        mark = self.store.staged()
        now, n = self.store.counted("events", R.queue_compacted(events.filter(T.detect_language(F.col("path")).isNotNull() & ~T.ignored(F.col("path")))))
        if n:
            hit = self.store.buckets_of(now) if self.store.has("queue") else None
            old = self.store.read("queue", hit) if hit else self._queue()
            like = lambda rows, id_: rows.select("path", "event_type", "priority", "created_at", F.lit(id_).cast("long").alias("id"))
            open_ = like(old.filter("status <> 'done'"), 0)
            fresh = R.queue_compacted(open_.join(now.select("path"), "path", "left_semi").unionByName(like(now, 1))).withColumns({c: F.lit(None).cast("timestamp") for c in ("processed_at", "claimed_at")})
            self.store.commit({"queue": R.without(old, now.select("path"), "path").unionByName(fresh)}, hit)
        self.store.release(mark)
        return n

    def pending(self) -> int:
        return self._queue().filter("status in ('pending', 'processing')").count()

    def clear(self, all_: bool = False) -> None:
        """Forgets done changes, or all."""
        self.store.commit({"queue": self._queue().filter(F.lit(False) if all_ else F.col("status") != "done")})

    def drain(self, root: str, limit: int | None = None) -> dict[str, int]:
        """One micro-batch: the next changes are claimed and indexed; they are done, or pending again where that fails.

        What a drain that died has claimed is claimed again `reclaim_s` seconds later. Only buckets of the batch are written.
        """
        stuck = F.current_timestamp() - F.make_interval(secs=F.lit(self.settings["indexing"]["reclaim_s"]))
        batch = R.claim(R.reclaimed(self._queue(), stuck), limit or self.settings["indexing"]["batch_files"]).collect()
        if not batch:
            return {"processed": 0, "failed": 0}
        none = self.spark.createDataFrame([], "path string")
        claimed = self.spark.createDataFrame([(r.path,) for r in batch], "path string")
        hit = self.store.buckets_of(claimed)
        self.store.commit({"queue": R.claimed(R.reclaimed(self.store.read("queue", hit), stuck), claimed)}, hit)
        gone = [r.path for r in batch if r.event_type == "deleted"]
        try:
            self.reindex(root, [r.path for r in batch if r.event_type != "deleted"], gone)
            done, failed = claimed, none
        except Exception as error:  # the batch goes back, whatever went wrong with it
            self.store.commit({}, last_error=str(error)[:500])
            done, failed = none, claimed
        queue = R.settled(self.store.read("queue", hit), done, failed)
        self.store.commit({"queue": queue.withColumn("processed_at", F.when(F.col("status") == "done", F.coalesce("processed_at", F.current_timestamp())))}, hit)
        return {"processed": 0 if failed is claimed else len(batch), "failed": len(batch) if failed is claimed else 0}

    def hash_scan(self, root: str, limit: int | None = None) -> int:
        """Enqueues files whose hash isn't the index's, `limit` at most by path; lost files aren't seen here."""
        most = limit or self.settings["hash_scan"]["files"]
        new = R.changed(sources.scan(self.spark, root), self.table("files"), "path", "file_hash").orderBy("path").limit(most)
        return self.enqueue(root, [r.path for r in new.select("path").collect()], "modified", HASH_SCAN)

    def git_refresh(self, root: str) -> dict[str, int]:
        """Enqueues what git calls changed, and drains the queue."""
        self.enqueue(root, sources.git_paths(root), "modified", GIT)
        total = {"processed": 0, "failed": 0}
        while (one := self.drain(root))["processed"]:
            total = {k: total[k] + one[k] for k in total}
        return total | {"failed": one["failed"]}

    # Answers

    def status(self) -> DataFrame:
        """(name, n): rows of each table, tokens of the tree, pending changes."""
        out = None
        for name in TABLES:
            one = self.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = one if out is None else out.unionByName(one)
        tokens = self.table("files").agg(F.expr("coalesce(sum(size_bytes), 0) div 4").alias("n")).select(F.lit("repo_tokens").alias("name"), "n")
        waiting = self._queue().agg(F.count_if(F.col("status").isin("pending", "processing")).alias("n")).select(F.lit("pending").alias("name"), "n")
        return out.unionByName(tokens).unionByName(waiting)

    def register(self, name: str, runner) -> None:
        """Adds a handler, or replaces one of the router's."""
        self.handlers[name] = runner

    def ask(self, question: str) -> tuple[str, DataFrame | None]:
        """(handler, rows); (ai_required, None) where the question needs reasoning."""
        name = planner.route(question)
        return name, None if name == "ai_required" else self.answer(name, question)

    def warning(self, name: str) -> str | None:
        """What to say beside the rows of a handler that goes by tags, where the index is stale."""
        return f"The index is out of date ({', '.join(self.stale())}): index again for full results." if name in _TAG_HANDLERS and self.stale() else None

    def answer(self, name: str, question: str) -> DataFrame:
        """Rows of a handler. Orders are total, so the limits of lists give the same rows each time."""
        if name in self.handlers:
            return self.handlers[name](self, question)
        symbols, what = self.table("symbols"), prompts.subject(question)
        place = ["name", "path", "start_line"]
        if name == "counts_by_kind":
            return symbols.groupBy(F.coalesce("kind", F.lit("(unknown)")).alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")
        if name == "grouped_routes":
            return H.by_owner(H.owned(H.route_items(symbols, self.table("edges")), symbols))
        if name in LIMITS:
            exact, part = F.col("name") == what, T.contains_like(F.col("name"), F.lit(what))
            columns = [*place, "end_line", "kind", "parent", "package"]
            if name == "where_is":
                return R.exact_else(symbols, exact, part, LIMITS[name], place).select(*columns)
            return symbols.filter(exact if name == "which_package" else part).orderBy(*place).limit(LIMITS[name]).select(*columns)
        if name in _TAGS or name == "tests":
            test = F.col("kind") == "test" if name == "tests" else F.array_contains("tags", _TAGS[name])
            return symbols.filter(test).orderBy(*place).limit(LIST_LIMIT).select(*place, "end_line", "kind", "tags")
        if name in _EDGES:
            return self.table("edges").filter(F.col("edge_type") == _EDGES[name]).orderBy("path", "start_line", "target", "source").limit(LIST_LIMIT)
        if name == "imports":
            hit = T.contains_like(F.col("path"), F.lit(what))
            return self.table("edges").filter((F.col("edge_type") == "imports") & hit).orderBy("path", "target", "source")
        raise ValueError(f"no handler {name}")

    # Context

    def release(self) -> None:
        """Deletes the stages behind what `context` and `ranked` gave; call it once those are read."""
        self.store.release()

    def ranked(self, prompt: prompts.Prompt, changed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """The best candidates for a prompt, most likely first, and its dependency context (role, names)."""
        chunks, edges, symbols, how = self.table("chunks"), self.table("edges"), self.table("symbols"), self.settings["retrieval"]
        parts = [h for resolver in self.resolvers for h in resolver(prompt, chunks, edges)]
        found = self.store.stage("hits", H.union(parts)) if parts else None
        if found is None or not found.limit(1).count():  # no resolver knows: words and vectors
            query = self.embedder(self.spark.createDataFrame([("q", prompt.text)], "chunk_id string, content string"))
            words = H.word_hits(chunks, prompt.keywords, how["lexical_top_k"], postings=self.store.read("postings"))
            found = self.store.stage("hits", words.unionByName(H.vector_hits(chunks, self.table("embeddings"), query, how["vector_top_k"])))
        names = self.store.stage("seeds", H.seeds(found, chunks, how["symbol_top_k"]))
        graph = H.graph_hits(chunks, symbols, edges, names, 2 if prompt.intent == "architecture_explanation" else 1)
        more = H.first_leg(graph).join(found.select("chunk_id"), "chunk_id", "left_anti")
        rows = H.scored(H.candidates(found.unionByName(more), chunks), prompt, changed)
        best = H.reranked(rows, max(how["rerank_top_k"], how["symbol_top_k"]))
        return self.store.stage("ranked", best), H.dependency_context(edges, names)

    def _packed(self, best: DataFrame, budget: int | None) -> DataFrame:
        items = best.withColumns({"g": F.lit(0), "minus": -F.col("score"), "tokens": T.chunk_tokens(F.col("content"))})
        fit = R.budget_packed(items, ["g"], ["minus", "ordinal"], "tokens", budget or self.settings["retrieval"]["max_context_tokens"])
        return fit.orderBy("minus", "ordinal").drop("g", "minus")

    def context(self, prompt: str, budget: int | None = None, changed: list[str] | None = None) -> DataFrame:
        """The best chunks that fit the budget, best first; they lie in stages of their own until `release`."""
        return self._packed(self.ranked(prompts.Prompt.read(prompt), changed)[0], budget)

    def retrieve(self, prompt: str, budget: int | None = None, root: str | None = None, full_diff: bool = False, intent: str | None = None) -> Answer:
        """The context with what is known about it; `root` adds git's changes and diff."""
        read = prompts.Prompt.read(prompt, intent)
        changed = sources.git_paths(root) if root else []
        best, around = self.ranked(read, changed)
        rows = [r.asDict(recursive=True) for r in self._packed(best, budget).collect()]
        sure = H.confidence(best, read).first()
        return self._answer(read, rows, {r.role: r.names for r in around.collect()}, sure.confidence, sure.reason, sources.git_diff(root, stat=not full_diff) if root and self.settings["retrieval"]["include_git_diff"] else "")

    def _answer(self, read: prompts.Prompt, rows: list[dict], around: dict, confidence: float, reason: str, diff: str) -> Answer:
        tokens = sum(max(1, len(r["content"]) // 4) if r["content"] else 0 for r in rows)
        whole = self.table("files").agg(F.expr("coalesce(sum(size_bytes), 0) div 4").alias("n")).first().n
        saved = 0.0 if whole <= 0 else round(max(0.0, min(100.0, (1 - tokens / whole) * 100)), 1)
        warnings = [] if rows else ["No chunk matched; the tree may not be indexed yet."]
        if confidence < 0.4:
            warnings.append("Low confidence: context may be missing. Try a more exact prompt.")
        warnings += [f"The file '{f}' isn't in the index." for f in read.files if not any(f.lower() in r["path"].lower() for r in rows)]
        return Answer(read.text, read.intent, rows, around, confidence, reason, whole, tokens, saved, warnings, diff)

    def verified(self, question: str, provider: verifier.Provider, root: str | None = None) -> Answer:
        """The context that a provider has judged; the plain one where the provider fails."""
        how, read = self.settings["verifier"], prompts.Prompt.read(question)
        got = verifier.verified(question, lambda q: self.context(q), provider, how["max_attempts"], how["min_confidence"])
        plain = self.retrieve(question, root=root)
        if not got.attempts:
            plain.logs = got.logs
            return plain
        rows = [r.asDict(recursive=True) for r in got.chunks.orderBy("ordinal").collect()]
        out = self._answer(read, rows, plain.dependencies, got.confidence, got.logs[-1], plain.diff)
        out.warnings, out.logs, out.explanation = out.warnings + got.warnings, got.logs, got.explanation
        return out

    def markdown(self, prompt: str, budget: int | None = None, root: str | None = None) -> str:
        return page(self.retrieve(prompt, budget, root))


def page(a: Answer) -> str:
    """An answer as a page of sections in a fixed order."""
    count = lambda kinds: sum(s["kind"] in kinds for s in a.symbols)
    out = ["# User Task", "", a.prompt.strip(), "", "# Intent", "", a.intent, "", "# Confidence", "", f"Score: {a.confidence:.2f}", f"Reason: {a.confidence_reason}", ""]
    out += ["# Token Savings", "", f"Whole tree: {a.repo_tokens:,} tokens", f"This context: {a.context_tokens:,} tokens", f"Saved: {a.reduction}%", f"{len(a.files)} files, {count(_TYPES)} types, {count(('route',))} routes and {count(('test',))} tests are included.", ""]
    out += ["# Relevant Files", "", *([f"* {p}: {why}" for p, why in a.files.items()] or ["* (none)"]), ""]
    out += ["# Target Symbols", "", *([f"* {s['symbol']} ({s['kind']}), {s['path']}:{s['start_line']}-{s['end_line']}" for s in a.symbols] or ["* (none)"]), "", "# Context Chunks"]
    for c in a.chunks:
        out += ["", f"### {c['path']}:{c['start_line']}-{c['end_line']} {c['symbol'] or ''}".rstrip(), f"Reason: {'; '.join(c['reasons']) or c['source']}", "", "```", c["content"], "```"]
    roles = ("callers", "callees", "interfaces", "implementations", "configs", "routes", "tests")
    out += [*([] if a.chunks else ["", "(no chunks)"]), "", "# Dependency Context", "", *[f"* {r}: {', '.join(a.dependencies.get(r, [])) or '(none)'}" for r in roles], ""]
    out += ["# Current Git Diff", "", *(["```diff", a.diff.strip(), "```"] if a.diff.strip() else ["(no uncommitted changes)"]), ""]
    out += ["# Missing Context Warnings", "", *([f"* {w}" for w in a.warnings] or ["* None"]), ""]
    if a.logs:
        out += ["# Context Verifier", "", *a.logs, ""]
    if a.explanation:
        out += ["# Verifier Explanation", "", a.explanation.strip(), ""]
    rules = ["Change relevant files only.", "Keep the architecture.", *(["Answer with a unified diff only."] if a.intent == "code_edit" else []), "Don't invent missing interfaces.", "Add or update tests where needed.", "Say what is assumed where context is incomplete."]
    return "\n".join([*out, "# Instructions", "", *[f"* {r}" for r in rules]]) + "\n"
