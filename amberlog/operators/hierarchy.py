"""Parent-child rows of unknown depth to full hierarchies, by peeling leaves.

One round does two things to the forest of nodes that are still live:

* *peel*: every node without live children leaves and sends its subtree size to its parent;
* *contract*: inner nodes with a single live child are taken out of long chains (those whose draw is above their parent's and their
  child's, a third of a chain): a chain of length L is gone after O(log L) rounds, not L.  What was taken out rides on the edge of the child:
  the number of names and the least of them, and the names themselves only where paths are asked for.

A node that leaves remembers the node it hung from, which leaves in a later round.  The live set shrinks geometrically; once at most RESIDUE
nodes hang from others, one task peels what is left in the same way in memory, since rounds of a few rows cost only their scheduling.  What no
peeling takes are loops.  The rounds are then gone through in reverse, so a node finds its parent finished and appends to its path.  Both
directions shuffle O(n) rows in all.  A hot parent is no group in one task: children only meet their parent in a join (split by adaptive
execution) and in sums that combine before the shuffle.

Defined results.  Null or empty names are no nodes.  A repeated name counts once, by the row with the greatest ``order`` (ties: smallest
parent name; a null order is the least).  A parent that is null, empty or defined nowhere makes its child a top node.  Nodes on a loop or
below one have ``steps`` -1 and the smallest name of the loop as root.  Nodes on a loop have no path, depth or descendants (null); below one
these are null too, or counted from the loop downwards where that is asked for.  Empty input gives no rows; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlog.plans.scratch import cut, discard

#: Nodes with a live parent that one task may finish in memory, without and with their paths (whose length is what the result has).
RESIDUE, RESIDUE_WITH_PATHS = 10_000, 1_000


def newest_links(rows: DataFrame, name: Column, parent: Column, order: Column) -> DataFrame:
    """(k, p): one row per non-empty name with the parent of its newest row; p null if that parent is no name itself."""
    x = rows.select(name.alias("k"), F.coalesce(parent, F.lit("")).alias("p0"), order.alias("o")).where("k <> ''")
    # max over a struct combines before the shuffle, so a name with many rows is no hot group
    newest = x.groupBy("k").agg(F.max(F.struct("o")).alias("m"), F.max_by("p0", F.struct("o", "p0")).alias("p0")).select("k", "p0")
    names = newest.select(F.col("k").alias("n"))
    return newest.join(names, F.col("p0") == F.col("n"), "left").select("k", F.col("n").alias("p"))


class _Edge:
    """What rides on the edge above a node: how many names, the least of them, and the names where they are wanted, as columns with a prefix."""

    def __init__(self, names: bool):
        self.columns = ("n", "least", "via") if names else ("n", "least")

    def bare(self) -> dict[str, Column]:
        all_ = {"n": F.lit(0).cast("bigint"), "least": F.lit(None).cast("string"), "via": F.array().cast("array<string>")}
        return {c: all_[c] for c in self.columns}

    def of(self, prefix: str = "") -> dict[str, Column]:
        return {c: F.col(prefix + c) for c in self.columns}

    def joined(self, name: str, upper: str) -> dict[str, Column]:
        """The edge of a node whose parent is taken out, with the parent's own edge."""
        all_ = {
            "n": F.col("n") + 1 + F.col(f"{upper}n"),
            "least": F.least("least", name, f"{upper}least"),
            "via": F.concat("via", F.array(name), F.col(f"{upper}via")) if "via" in self.columns else None,
        }
        return {c: all_[c] for c in self.columns}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def peel(links: DataFrame, paths: bool = False, residue: int | None = None, max_rounds: int = 200) -> tuple[DataFrame, list[DataFrame]]:
    """(what stays and is finished, [what left in round 1, in round 2, ...]) for links (k, p).

    Columns of what is finished: k, root, steps, path, descendants, on_loop.  Columns of a row that left: k, target, the edge between, size
    (nodes below k as far as known), child (the one child whose own count is to be added, null if size is final) and child_size (what hung between).
    """
    residue = (RESIDUE_WITH_PATHS if paths else RESIDUE) if residue is None else residue
    edge = _Edge(paths)
    # h and g are the draws of a node and its parent; each round hashes them anew, with the same expression, so that no round compiles code anew
    draw = F.xxhash64
    zero, none = F.lit(0).cast("bigint"), F.lit(None)
    live = cut(links.select("k", "p", *_named(edge.bare()), zero.alias("sz"), zero.alias("esz"), draw("k").alias("h"), draw("p").alias("g")))
    sent = live.select(F.col("k").alias("to"), zero.alias("add")).limit(0)
    gone: list[DataFrame] = []
    for _ in range(max_rounds):
        hanging = live.where("p is not null and p <> k")
        if hanging.count() <= residue:
            break
        # what each live node hears from its children: how many there are, the highest draw, and the sizes sent by those that left before
        heard = (
            hanging.select(F.col("p").alias("to"), F.lit(1).cast("bigint").alias("one"), zero.alias("add"), F.col("h").alias("top"))
            .unionByName(sent.select("to", zero.alias("one"), "add", F.lit(None).cast("bigint").alias("top")))
            .groupBy("to")
            .agg(F.sum("one").alias("c"), F.sum("add").alias("add"), F.max("top").alias("top"))
        )
        inner = F.col("p").isNotNull() & (F.col("p") != F.col("k"))
        alone = inner & (F.coalesce("c", F.lit(0)) == 1) & (F.col("h") > F.col("g")) & (F.col("h") > F.col("top"))
        told = live.join(heard, F.col("k") == F.col("to"), "left").select(
            "k", "p", *edge.columns, (F.col("sz") + F.coalesce("add", F.lit(0))).alias("sz"), "esz", "h", "g", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce(alone, F.lit(False)).alias("out")
        )
        up = told.select(*(F.col(c).alias(f"u_{c}") for c in ("k", "p", *edge.columns, "sz", "esz", "out", "g")))
        # a node that is its own parent must not meet itself as a child
        both = told.join(up, F.when(inner, F.col("p")) == F.col("u_k"), "left")
        skip = F.coalesce("u_out", F.lit(False))
        both = both.select(
            "k", "sz", "c", "out", "h", skip.alias("skip"), *(f"u_{c}" for c in ("k", "p", *edge.columns, "sz", "esz")), F.col("esz").alias("esz0"),
            F.when(skip, F.col("u_g")).otherwise(F.col("g")).alias("g"),
            F.when(skip, F.col("u_p")).otherwise(F.col("p")).alias("p"),
            *(F.when(skip, c).otherwise(F.col(n)).alias(n) for n, c in edge.joined("u_k", "u_").items()),
            (F.col("esz") + F.when(skip, 1 + F.col("u_sz") + F.col("u_esz")).otherwise(0)).alias("esz"),
        )
        leaf = (F.col("c") == 0) & F.col("p").isNotNull() & (F.col("p") != F.col("k"))
        h, g = draw("h"), F.when(F.col("p").isNotNull(), draw("g"))

        def kind(name, k, p, over, sz, esz, child, h=none, g=none):
            parts = {"k": k, "p": p} | over | {"child": child.cast("string")} | {n: c.cast("bigint") for n, c in (("sz", sz), ("esz", esz), ("h", h), ("g", g))}
            return F.struct(F.lit(name).alias("kind"), *_named(parts))

        k, p, sz, esz = (F.col(c) for c in ("k", "p", "sz", "esz"))
        below = 1 + sz + F.col("esz0")
        rows = F.array_compact(
            F.array(
                F.when(leaf, kind("gone", k, p, edge.of(), sz, F.lit(0), none)),
                F.when(~leaf & ~F.col("out"), kind("live", k, p, edge.of(), sz, esz, none, h, g)),
                F.when(
                    F.col("skip"),
                    kind("gone", F.col("u_k"), F.col("u_p"), edge.of("u_"), F.col("u_sz") + F.when(leaf, below).otherwise(0), F.when(leaf, 0).otherwise(1 + F.col("esz0")), F.when(~leaf, k)),
                ),
                F.when(leaf, kind("sent", p, none.cast("string"), edge.bare(), 1 + sz + esz, F.lit(0), none)),
            )
        )
        step = cut(both.select(F.explode(rows).alias("x")).select("x.*"))
        gone.append(step.where("kind = 'gone'").select("k", F.col("p").alias("target"), *edge.columns, F.col("sz").alias("size"), "child", F.col("esz").alias("child_size")))
        live = step.where("kind = 'live'").select("k", "p", *edge.columns, "sz", "esz", "h", "g")
        sent = step.where("kind = 'sent'").select(F.col("k").alias("to"), F.col("sz").alias("add"))
    else:
        raise RuntimeError(f"not peeled after {max_rounds} rounds")
    last = sent.groupBy("to").agg(F.sum("add").alias("add"))
    live = live.join(last, F.col("k") == F.col("to"), "left").select("k", "p", *edge.columns, (F.col("sz") + F.coalesce("add", F.lit(0))).alias("sz"), "esz")
    # tops that nothing hangs from are finished, however many there are; the rest, at most twice RESIDUE rows and the loops, goes through one task
    held = live.where("p is not null and p <> k").select(F.col("p").alias("held")).distinct()
    marked = live.join(held, F.col("k") == F.col("held"), "left").withColumn("open", (F.col("p").isNotNull() & (F.col("p") != F.col("k"))) | F.col("held").isNotNull())
    loop = F.col("p").isNotNull()
    path = F.array("k") if paths else F.lit(None).cast("array<string>")
    closed = marked.where("not open").select(
        "k", F.when(loop, F.least("k", "least")).otherwise(F.col("k")).alias("root"), F.when(loop, -1).otherwise(0).cast("bigint").alias("steps"),
        F.when(~loop, path).alias("path"), F.when(~loop, F.col("sz")).alias("descendants"), loop.alias("on_loop"),
    )
    # a shuffle, since merely coalescing would pull the joins above into the one task
    rest = marked.where("open").select("k", "p", *edge.columns, "sz", "esz").repartition(1).mapInArrow(_finish(paths), FINISHED)
    return closed.unionByName(rest), gone


FINISHED = "k string, root string, steps bigint, path array<string>, descendants bigint, on_loop boolean"


def _finish(paths: bool):
    """The function that peels the last nodes in one task: leaves first, then roots, steps and paths in reverse order; what is left are loops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {r["k"]: r for b in batches for r in b.to_pylist()}
        kids = dict.fromkeys(rows, 0)
        for r in rows.values():
            if r["p"] is not None:
                kids[r["p"]] += 1
        size = {k: r["sz"] for k, r in rows.items()}
        order = [k for k, c in kids.items() if not c]
        for k in order:  # grows while it is read
            p = rows[k]["p"]
            if p is not None:
                size[p] += 1 + size[k] + rows[k]["esz"]
                kids[p] -= 1
                if not kids[p]:
                    order.append(p)
        done: dict[str, tuple] = {}
        for k in set(rows).difference(order):
            if k not in done:
                ring = [k]
                while rows[ring[-1]]["p"] != k:
                    ring.append(rows[ring[-1]]["p"])
                root = min(x for r in ring for x in (r, rows[r]["least"]) if x is not None)
                done |= dict.fromkeys(ring, (root, -1, None, None, True))
        for k in reversed(order):
            p = rows[k]["p"]
            if p is None:
                done[k] = (k, 0, [k] if paths else None, size[k], False)
            else:
                root, steps, path, _, on_loop = done[p]
                # below a loop a path begins right under it
                path = [*((path or []) if not on_loop else []), *reversed(rows[k]["via"]), k] if paths else None
                done[k] = (root, -1 if steps < 0 else steps + rows[k]["n"] + 1, path, size[k], False)
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.bool_())
        names = ("root", "steps", "path", "descendants", "on_loop")
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.string()), *(pa.array([v[i] for v in done.values()], t) for i, t in enumerate(kinds))], ["k", *names])

    return run


def hierarchy(links: DataFrame, paths: bool = True, below_loops: bool = False, residue: int | None = None) -> DataFrame:
    """(name, parent, root, steps, depth, path, descendants, in_loop, on_loop) for links (k, p).

    ``path`` leads from the top node to the node itself; ``descendants`` is the number of nodes below; ``in_loop`` tells nodes on a loop
    or below it, ``on_loop`` those on it.  With ``below_loops`` nodes below a loop have path, depth and descendants too, counted from the node
    right under the loop.  With ``paths`` false, path and descendants are null, on_loop is, and none is carried through the rounds.
    """
    finished, gone = peel(links, paths, residue)
    done = cut(finished) if gone else finished
    for i, left in enumerate(reversed(gone)):
        up = done.select(*(F.col(c).alias(f"u_{c}") for c in ("k", "root", "steps", "path", "on_loop")))
        x = left.join(up, F.col("target") == F.col("u_k"))
        if paths:
            x = x.join(done.select(F.col("k").alias("d_k"), F.col("descendants").alias("d_n"), F.col("on_loop").alias("d_loop")), F.col("child") == F.col("d_k"), "left")
            ring = F.coalesce("d_loop", F.lit(False))  # the parent of a node on a loop is on it
            start = F.when(F.col("u_on_loop"), F.array().cast("array<string>")).otherwise(F.col("u_path"))
            carried = {
                "path": F.when(~ring, F.concat(start, F.reverse("via"), F.array("k"))),
                "descendants": F.when(~ring, F.col("size") + F.col("child_size") + F.coalesce("d_n", F.lit(0))),
                "on_loop": ring,
            }
        else:
            carried = {"path": F.lit(None).cast("array<string>"), "descendants": F.lit(None).cast("bigint"), "on_loop": F.lit(None).cast("boolean")}
        steps = F.when(F.col("u_steps") < 0, F.lit(-1)).otherwise(F.col("u_steps") + F.col("n") + 1).cast("bigint")
        new = done.unionByName(x.select("k", F.col("u_root").alias("root"), steps.alias("steps"), *_named(carried)))
        if i < len(gone) - 1:
            new = cut(new)
            discard(done)
        done = new
    shown = F.lit(True) if below_loops else F.col("steps") >= 0
    depth = F.when(F.col("path").isNotNull(), F.size("path") - 1) if paths else F.when(F.col("steps") >= 0, F.col("steps"))
    out = done.join(links.select(F.col("k").alias("l_k"), F.col("p").alias("parent")), F.col("k") == F.col("l_k")) if paths else done.withColumn("parent", F.lit(None).cast("string"))
    return out.select(
        F.col("k").alias("name"), "parent", "root", F.col("steps").cast("int").alias("steps"), F.when(shown, depth).cast("int").alias("depth"), F.when(shown, F.col("path")).alias("path"),
        F.when(shown, F.col("descendants")).alias("descendants"), (F.col("steps") < 0).alias("in_loop"), "on_loop",
    )


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): every descendant of every node as rows, from the paths, without a join or a list per ancestor."""
    return (
        tree.where("path is not null")
        .select("name", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor"), "depth")
        .select("ancestor", F.col("name").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))
    )
