"""State from event logs (E1-E14) and the ledger (K1)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.folds import ordered_fold
from karst.functions.ranks import global_rank, previous, running

# -- task claims (E1-E6) ------------------------------------------------------------------------------------------------

TASK_EVENT = "log_id string, seq long, at_ms long, task string, kind string, by string, hlc long, lease_ms long, winner string, winner_hlc long, granted_seq long, lease_expires_ms long, stale_seq long"
# The names of the events in logs.
EVENT_NAMES = {"task.open": "open", "claim.request": "request", "claim.grant": "grant", "claim.release": "release", "task.superseded": "superseded"}
TASK_STATE = "log_id string, task string, state string, winner string, grant_seq long, granted_seq long, lease_expires_ms long, candidate string, candidate_seq long, requests int, epoch_start_seq long"


@dataclass(frozen=True)
class Hold:
    """A grant that is in force until something closes its epoch, whether or not its lease has run out."""

    seq: int
    winner: str | None
    granted_seq: int
    expires: int

    def closed_by(self, e: dict) -> bool:
        """By its winner's release, or by being named as stale."""
        return e["by"] == self.winner if e["kind"] == "release" else e["kind"] == "superseded" and e["stale_seq"] == self.seq

    def yields_to(self, e: dict) -> bool:
        return self.expires <= (e["at_ms"] or 0)


@dataclass(frozen=True)
class TaskFold:
    """The state of one task after its events in order of seq.

    Epochs follow each other: one begins at the start, at an opening, and where a hold is closed. Within an epoch a grant takes hold
    where there is none, or where the lease of the one before had run out when it came. Bids (hlc, seq, by) compete since the epoch began or
    the hold was taken, the least wins; so all that must be kept of them is their number and the least.
    """

    epoch: int = 0
    base: str = "open"
    hold: Hold | None = None
    requests: int = 0
    best: tuple | None = None

    def control(self, e: dict) -> TaskFold:
        """After an event that is no request; one that isn't later than the epoch's begin changes nothing."""
        if e["seq"] <= self.epoch:
            return self
        if e["kind"] == "open" or self.hold is not None and self.hold.closed_by(e):
            return TaskFold(e["seq"], "released" if e["kind"] == "release" else "open")
        if e["kind"] == "grant" and (self.hold is None or self.hold.yields_to(e)):
            return replace(self, hold=Hold(e["seq"], e["winner"], e["granted_seq"] or 0, e["lease_expires_ms"] or 0), best=None)
        return self

    def step(self, e: dict) -> TaskFold:
        if e["kind"] != "request" or e["seq"] <= self.epoch:
            return self.control(e)
        bid = (e["hlc"] or 0, e["seq"], e["by"])
        return replace(self, requests=self.requests + 1, best=bid if self.best is None else min(self.best, bid))

    def state(self, now_ms: int) -> tuple:
        """(state, winner, grant_seq, granted_seq, lease_expires_ms, candidate, candidate_seq, requests, epoch_start_seq)."""
        h = self.hold
        name = self.base if h is None else "claimed" if h.expires > now_ms else "expired"
        _, seq, by = self.best if self.best is not None and name != "claimed" else (None, None, None)
        return (name, *((h.winner, h.seq, h.granted_seq, h.expires) if h else (None,) * 4), by, seq, self.requests, self.epoch)


CONTROL = "log_id string, task string, epoch long, base string, grant_seq long, winner string, granted_seq long, lease_expires_ms long"


def task_states(events: DataFrame, now_ms: int) -> DataFrame:
    """The state of each (log_id, task) of typed events; rows without task or of unknown kind are passed over.

    Only openings, grants, releases and supersessions depend on each other and stream through a fold. Requests, which may be many of one task,
    are counted and compared by aggregates over what the fold leaves.
    """
    d = events.filter(F.col("task").isNotNull() & F.col("kind").isin("open", "request", "grant", "release", "superseded"))

    def end(key: tuple, s: TaskFold):
        h = s.hold
        yield (*key, s.epoch, s.base, *((h.seq, h.winner, h.granted_seq, h.expires) if h else (None,) * 4))

    control = ordered_fold(d.filter("kind <> 'request'"), ["log_id", "task"], ["seq"], CONTROL, lambda _k: TaskFold(), lambda s, e: (s.control(e), ()), end)
    bid = F.struct(F.coalesce("hlc", F.lit(0)).alias("hlc"), "seq", "by")
    asked = d.filter("kind = 'request'").select("log_id", "task", "seq", bid.alias("bid")).join(control.select("log_id", "task", "epoch", F.col("grant_seq").alias("held")), ["log_id", "task"], "left")
    counts = F.col("seq") > F.coalesce("epoch", F.lit(0))
    competes = counts & (F.col("seq") > F.coalesce("held", F.lit(0)))
    asked = asked.groupBy("log_id", "task").agg(F.sum(counts.cast("int")).cast("int").alias("requests"), F.min(F.when(competes, F.col("bid"))).alias("best"))
    both = control.join(asked, ["log_id", "task"], "full")
    state = F.when(F.col("grant_seq").isNull(), F.coalesce("base", F.lit("open"))).when(F.col("lease_expires_ms") > now_ms, "claimed").otherwise("expired")
    free = lambda c: F.when(F.col("state") != "claimed", F.col(c))
    both = both.withColumn("state", state)
    return both.select(
        "log_id", "task", "state", "winner", "grant_seq", "granted_seq", "lease_expires_ms", free("best.by").alias("candidate"), free("best.seq").alias("candidate_seq"),
        F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("epoch", F.lit(0)).cast("long").alias("epoch_start_seq"),
    )


def decode_task_events(events: DataFrame) -> DataFrame:
    """Typed task events of log events (log_id, seq, ingest_ms, payload JSON); what is no task event is passed over.

    Clocks (``hlc``, ``winner_hlc``) are hexadecimal text of 1 to 16 digits, anything else counts as 0.
    """
    p = F.from_json(F.col("payload").cast("string"), "t string, task string, by string, hlc string, lease_ms long, winner string, winner_hlc string, granted_seq long, lease_expires_ms long, stale_seq long, outcome string")
    kind = F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])[F.col("p.t")]
    d = events.select("log_id", "seq", F.col("ingest_ms").alias("at_ms"), p.alias("p")).filter("p.task is not null")
    clock = lambda c: F.when(F.col(c).rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(F.col(c), 16, -10).cast("long")).otherwise(F.lit(0).cast("long"))
    columns = [clock(f"p.{c}").alias(c) if c.endswith("hlc") else F.col(f"p.{c}") for c in ("by", "hlc", "lease_ms", "winner", "winner_hlc", "granted_seq", "lease_expires_ms", "stale_seq")]
    return d.select("log_id", "seq", "at_ms", "p.task", kind.alias("kind"), *columns).filter("kind is not null")


def task_payload(kind: str, **columns: Column | str | int) -> Column:
    """The JSON of a task event of a kind of ``EVENT_NAMES``; clocks are written as 16 hexadecimal digits."""
    value = lambda c: c if isinstance(c, Column) else F.lit(c)
    hexed = lambda k, c: F.lower(F.lpad(F.hex(value(c).cast("long")), 16, "0")) if k.endswith("hlc") else value(c)
    return F.to_json(F.struct(F.lit(kind).alias("t"), *[hexed(k, c).alias(k) for k, c in columns.items()]))


def grants_to_make(events: DataFrame, now_ms: int) -> DataFrame:
    """(log_id, task, winner, granted_seq) that an arbiter would grant now: the candidates of tasks that no one holds."""
    return task_states(events, now_ms).filter("candidate is not null").select("log_id", "task", F.col("candidate").alias("winner"), F.col("candidate_seq").alias("granted_seq"))


def may_release(states: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (log_id, task, by, outcome) that may release: by the winner, with outcome applied, failed or blocked; also after the lease."""
    return requests.filter(F.col("outcome").isin("applied", "failed", "blocked")).join(states.filter("grant_seq is not null").select("log_id", "task", F.col("winner").alias("by")), ["log_id", "task", "by"], "left_semi")


def may_supersede(events: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """E5: requests (log_id, task, stale_seq) whose target is a grant that has run out or is not the current one."""
    g = events.filter("kind = 'grant'").select("log_id", "task", F.col("seq").alias("stale_seq"), "lease_expires_ms")
    now = task_states(events, now_ms).select("log_id", "task", F.col("grant_seq").alias("current"))
    d = requests.join(g, ["log_id", "task", "stale_seq"]).join(now, ["log_id", "task"], "left")
    return d.filter((F.col("lease_expires_ms") <= now_ms) | ~F.col("current").eqNullSafe(F.col("stale_seq"))).select(requests.columns)


# -- trust (E8-E10) -----------------------------------------------------------------------------------------------------


def trust_capabilities(trust: DataFrame, org: str | None, at_ms: int, valid: Column | None = None, to_org: str | None = None) -> DataFrame:
    """(grant_seq, from_org, to_org, cap_bits, prefixes, expires_at_ms) that hold at a time.

    Only rows of ``org`` (None: each granter for itself) for which ``valid`` holds count. A revoke ends the grant of its grant_seq and
    to_org if it comes after the grant. A grant holds until expires_at_ms (0 or null: for ever). Repeated rows count once.
    """
    d = trust.filter(valid if valid is not None else F.lit(True))
    if org is not None:
        d = d.filter(F.col("from_org") == org)
    g = d.filter("kind = 'grant'").select(F.col("seq").alias("grant_seq"), "from_org", "to_org", "cap_bits", "prefixes", "expires_at_ms").filter("from_org is not null and to_org is not null").dropDuplicates(["grant_seq"])
    r = d.filter("kind = 'revoke'").select(F.col("grant_seq").alias("r_grant"), F.col("from_org").alias("r_from"), F.col("to_org").alias("r_to"), F.col("seq").alias("r_seq"))
    # Of the revokes of a grant the last one decides; so the join is one to one, however often a grant is revoked.
    r = r.groupBy("r_grant", "r_from", "r_to").agg(F.max("r_seq").alias("r_seq"))
    g = g.join(r, (F.col("grant_seq") == F.col("r_grant")) & (F.col("from_org") == F.col("r_from")) & (F.col("to_org") == F.col("r_to")) & (F.col("r_seq") > F.col("grant_seq")), "left_anti")
    exp = F.coalesce("expires_at_ms", F.lit(0))
    g = g.filter((exp == 0) | (exp > at_ms))
    return g if to_org is None else g.filter(F.col("to_org") == to_org)


def invalid_events(trust: DataFrame, org: str, valid: Column) -> DataFrame:
    """(invalid_events): rows with a bad signature or of another granter."""
    return trust.agg(F.coalesce(F.sum((~F.coalesce(valid, F.lit(False)) | ~F.col("from_org").eqNullSafe(F.lit(org))).cast("int")), F.lit(0)).alias("invalid_events"))


def authorized(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Requests (org, bits, key) for which one capability has all bits and a prefix of the key.

    The join is on org and on the key cut to each length a prefix has, so it is an equi join, not a scan of all pairs.
    """
    c = capabilities.select(F.col("to_org").alias("org"), "cap_bits", F.explode("prefixes").alias("prefix")).distinct()
    lengths = c.select("org", F.length("prefix").alias("n")).distinct()
    r = requests.join(lengths, "org").withColumn("prefix", F.expr("left(key, n)")).filter(F.length("key") >= F.col("n"))
    ok = r.join(c, ["org", "prefix"]).filter(F.col("cap_bits").bitwiseAND(F.col("bits")) == F.col("bits"))
    return ok.select(requests.columns).distinct()


def longest_prefix(rows: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Rows (key, ...) with the longest of ``namespaces`` (ns) their key begins with, as an equi join by prefix length."""
    ns = namespaces.select("ns").distinct()
    lengths = ns.agg(F.collect_set(F.length("ns")).alias("lengths"))  # as many as there are lengths
    d = rows.join(lengths, F.lit(True)).withColumn("ns", F.explode(F.transform("lengths", lambda n: F.substring("key", 1, n)))).drop("lengths")
    d = d.join(ns, "ns")
    return d.groupBy(*rows.columns).agg(F.max_by("ns", F.length("ns")).alias("ns"))


# -- presence (E11-E13) ---------------------------------------------------------------------------------------------------


def agents(events: DataFrame) -> DataFrame:
    """(by, last_seen_ms, first_seq) of each agent named in the JSON payloads, in order of first appearance."""
    by = F.get_json_object(F.col("payload").cast("string"), "$.by")
    d = events.select(by.alias("by"), "ingest_ms", "seq").filter("by is not null and by <> ''")
    return d.groupBy("by").agg(F.max("ingest_ms").alias("last_seen_ms"), F.min("seq").alias("first_seq")).orderBy("first_seq", "by")


def transitions(snapshots: DataFrame) -> DataFrame:
    """(node, ts_ms, change) where a node's state differs from its last: suspect, recover, dead or left; a new node changes nothing."""
    kind = F.when(F.col("state") == "alive", "recover").when(F.col("state") == "suspected", "suspect").otherwise(F.col("state"))
    d = previous(snapshots.select("node", "ts_ms", "state"), ["node"], F.floor(F.col("ts_ms") / 86_400_000), ["ts_ms", "state"], ["state"], "before")
    return d.filter("before is not null and before.state <> state").select("node", "ts_ms", kind.alias("change"))


# -- hybrid clocks (E14) ----------------------------------------------------------------------------------------------------


def hybrid_clock(events: DataFrame) -> DataFrame:
    """Adds ``hlc`` to (node, seq, wall_ms): max(wall << 16, last + 1), by its closed form: i + the running maximum of (wall << 16) - i."""
    part = F.floor(F.col("seq") / 65_536)
    d = global_rank(events, ["node"], part, ["seq"], "__i")
    ahead = F.shiftleft(F.col("wall_ms").cast("long"), 16) - F.col("__i")
    d = running(d, ["node"], part, ["seq"], ahead, "__m", largest=True)
    return d.withColumn("hlc", F.col("__m") + F.col("__i")).drop("__i", "__m")


def hlc_parts(hlc: Column) -> tuple[Column, Column]:
    """Milliseconds and counter."""
    return F.shiftrightunsigned(hlc, 16), hlc.bitwiseAND(F.lit(65535).cast("long"))


MAX_AHEAD_MS = 60_000


def observe(last: int, wall_ms: int, remote: int) -> int:
    """The clock after a remote value, which counts as at most a minute ahead of the wall clock."""
    return max(wall_ms << 16, last + 1, min(remote, (wall_ms + MAX_AHEAD_MS) << 16) + 1)


# -- ledger (K1) ------------------------------------------------------------------------------------------------------------


@dataclass
class Ledger:
    """Applies transfers in order; a transfer names its refusal, else null."""

    balances: dict[str, int] = field(default_factory=dict)

    def apply(self, src: str, dst: str, amount: int | None) -> str | None:
        if amount is None or amount <= 0:
            return "amount"
        if src == dst:
            return "same account"
        if src not in self.balances or dst not in self.balances:
            return "no account"
        if self.balances[src] < amount:
            return "insufficient_funds"
        self.balances[src] -= amount
        self.balances[dst] += amount
        return None


TRANSFER = "book string, seq long, src string, dst string, amount long, refused string"


def transfers(rows: DataFrame) -> DataFrame:
    """Outcome of each transfer (book, seq, src, dst, amount): books are independent, a book's transfers depend on each other.

    A row without src credits dst and opens its account.
    """

    def step(ledger: Ledger, r: dict):
        if r["src"] is None:
            ok = r["dst"] is not None and r["amount"] is not None and r["amount"] >= 0
            if ok:
                ledger.balances[r["dst"]] = ledger.balances.get(r["dst"], 0) + r["amount"]
            why = None if ok else "amount"
        else:
            why = ledger.apply(r["src"], r["dst"], r["amount"])
        return ledger, [(r["book"], r["seq"], r["src"], r["dst"], r["amount"], why)]

    return ordered_fold(rows, ["book"], ["seq"], TRANSFER, lambda _k: Ledger(), step)


def balances(outcomes: DataFrame) -> DataFrame:
    """(book, account, balance) after the transfers that weren't refused: an aggregation, so in any order."""
    d = outcomes.filter("refused is null")
    moves = d.select("book", F.col("dst").alias("account"), F.col("amount")).unionByName(d.filter("src is not null").select("book", F.col("src").alias("account"), (-F.col("amount")).alias("amount")))
    return moves.groupBy("book", "account").agg(F.sum("amount").alias("balance"))
