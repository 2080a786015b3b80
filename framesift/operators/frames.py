"""Frames and slots over a long table (oid, slot, value).

Updates give new stores; nothing changes in place. All operators are joins, filters and partial aggregates on the long
table, which is meant to be written partitioned by slot, so that a slot is a pruned scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import closures
from .masks import all_hold

SLOTS = ["oid", "slot", "value"]


class FrameStore:
    def __init__(self, slots: DataFrame, computed: dict[str, Callable[[FrameStore], DataFrame]] | None = None):
        """``computed`` maps a slot to a function that derives (oid, value) rows from the store."""
        self.slots = slots.select(*SLOTS)
        self.computed = computed or {}

    # building

    @staticmethod
    def from_wide(df: DataFrame, oid: Column | str, slots: list[str]) -> FrameStore:
        """DOSLOTS on a wide table: unpivot, values as strings, absent values dropped."""
        o = F.col(oid) if isinstance(oid, str) else oid
        pairs = F.array(*(F.struct(F.lit(s).alias("slot"), F.col(s).cast("string").alias("value")) for s in slots))
        return FrameStore(df.select(o.alias("oid"), F.explode(pairs).alias("p")).select("oid", "p.slot", "p.value").filter(F.col("value").isNotNull()))

    def with_rows(self, rows: DataFrame) -> FrameStore:
        return FrameStore(rows, self.computed)

    # reading

    def pget(self, slot: str | list[str]) -> DataFrame:
        """%GET, PGET: stored values, (oid, value). FD:MULTI-GET for several slots."""
        names = [slot] if isinstance(slot, str) else slot
        return self.slots.filter(F.col("slot").isin(*names)).select("oid", "value").distinct()

    multi_get = pget

    def get(self, slot: str) -> DataFrame:
        """GET, FGET, FRAME-GET: computed slots win over stored values."""
        return self.computed[slot](self).select("oid", "value").distinct() if slot in self.computed else self.pget(slot)

    def get_of(self, frames: DataFrame, slot: str) -> DataFrame:
        """GET of given frames (oid)."""
        return self.get(slot).join(frames.select("oid").distinct(), "oid", "left_semi")

    def cachable_get(self, slot: str) -> DataFrame:
        """FD:CACHABLE-GET: stored values, else derived ones, per frame."""
        stored = self.pget(slot)
        if slot not in self.computed:
            return stored
        return stored.unionByName(self.computed[slot](self).select("oid", "value").distinct().join(stored.select("oid").distinct(), "oid", "left_anti"))

    def cached_get(self, slot: str) -> FrameStore:
        """FD:CACHED-GET: a store that holds the derived values as well."""
        return self.add(self.cachable_get(slot).withColumn("slot", F.lit(slot)))

    def follow(self, start: DataFrame, *path: str) -> DataFrame:
        """(get (get x s1) s2): (oid, value) at the end of a path of slots whose values are oids."""
        out = start.select("oid", F.col("oid").cast("string").alias("value"))
        for slot in path:
            nxt = self.get(slot).select(F.col("oid").cast("string").alias("_o"), F.col("value").alias("_v"))
            out = out.join(nxt, out["value"] == nxt["_o"]).select("oid", F.col("_v").alias("value")).distinct()
        return out

    def test(self, slots: list[str], values: list) -> DataFrame:
        """TEST, %TEST, FTEST, FCHECK, FRAME-TEST, FD:MULTI-TEST: frames with any of the values in any of the slots."""
        plain = [s for s in slots if s not in self.computed]
        found = self.slots.filter(F.col("slot").isin(*plain) & F.col("value").isin(*map(str, values))).select("oid")
        for s in slots:
            if s in self.computed:
                found = found.unionByName(self.get(s).filter(F.col("value").isin(*map(str, values))).select("oid"))
        return found.distinct()

    def pick(self, *clauses: tuple[str, list]) -> DataFrame:
        """PICK: frames that satisfy every (slot, values) pair. One scan, one grouped bit mask instead of n joins."""
        return all_hold(self.slots, list(clauses))

    def frame_slots(self) -> DataFrame:
        """FRAME-SLOTS, FSLOTS."""
        return self.slots.select("oid", "slot").distinct()

    def count_slots(self) -> DataFrame:
        return self.frame_slots().groupBy("oid").agg(F.count("*").alias("n"))

    def do_slots(self) -> DataFrame:
        """DOSLOTS: (oid, slot, values as a set)."""
        return self.slots.groupBy("oid", "slot").agg(F.array_sort(F.collect_set("value")).alias("values"))

    def with_slots(self, *slots: str) -> DataFrame:
        """WITH-SLOTS: slots as columns holding sets; (oid, slot...)."""
        rows = self.slots.filter(F.col("slot").isin(*slots))
        return rows.groupBy("oid").agg(*(F.array_sort(F.collect_set(F.when(F.col("slot") == s, F.col("value")))).alias(s) for s in slots))

    def lookup_frame(self, name: str, slot: str = "obj-name") -> DataFrame:
        """LOOKUP-FRAME, $$."""
        return self.slots.filter((F.col("slot") == slot) & (F.col("value") == name)).select("oid").distinct()

    def export_frames(self) -> DataFrame:
        """EXPORT-FRAME, XF: (oid, json)."""
        return self.do_slots().groupBy("oid").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "values"))))).alias("json"))

    @staticmethod
    def import_frames(df: DataFrame) -> FrameStore:
        """IMPORT-FRAME: from (oid, json)."""
        m = F.from_json("json", "map<string,array<string>>")
        rows = df.select("oid", F.explode(m).alias("slot", "values"))
        return FrameStore(rows.select("oid", "slot", F.explode("values").alias("value")))

    # writing

    def add(self, rows: DataFrame) -> FrameStore:
        """ADD!, FRAME-ADD!, PADD!, %ADD, FADD!: set union."""
        return self.with_rows(self.slots.unionByName(rows.select(*SLOTS)).distinct())

    def assert_(self, rows: DataFrame, validators: dict[str, Column] | None = None, effects: Callable[[DataFrame], DataFrame] | None = None) -> FrameStore:
        """ASSERT!: adding with validators per slot and further rows as effects."""
        ok = rows
        for slot, test in (validators or {}).items():
            ok = ok.filter((F.col("slot") != slot) | F.coalesce(test, F.lit(False)))
        return self.add(ok if effects is None else ok.select(*SLOTS).unionByName(effects(ok).select(*SLOTS)))

    def drop(self, rows: DataFrame) -> FrameStore:
        """DROP!, %REMOVE."""
        return self.with_rows(self.slots.join(rows.select(*SLOTS).distinct(), SLOTS, "left_anti"))

    def retract(self, rows: DataFrame, effects: Callable[[DataFrame], DataFrame]) -> FrameStore:
        """RETRACT!: dropping, with further rows dropped as effects."""
        return self.drop(rows.select(*SLOTS).unionByName(effects(rows).select(*SLOTS)))

    def set_(self, rows: DataFrame) -> FrameStore:
        """FRAME-SET!, FSET!, PSET!, %SET!: the slot's values become exactly these."""
        return self.with_rows(self.zap(rows).slots.unionByName(rows.select(*SLOTS).distinct()))

    def zap(self, keys: DataFrame) -> FrameStore:
        """FRAME-ZAP!, FZAP!: from (oid, slot)."""
        return self.with_rows(self.slots.join(keys.select("oid", "slot").distinct(), ["oid", "slot"], "left_anti"))

    def use_frames(self, named: DataFrame, slot: str = "obj-name") -> FrameStore:
        """USE-FRAME, DEFFRAME: create the frames (oid, name) whose name nobody has."""
        have = self.slots.filter(F.col("slot") == slot).select(F.col("value").alias("name")).distinct()
        return self.add(named.join(have, "name", "left_anti").select("oid", F.lit(slot).alias("slot"), F.col("name").alias("value")))

    def copy_frames(self, mapping: DataFrame, slots: list[str] | None = None) -> FrameStore:
        """COPY-FRAME: (oid, new_oid) pairs; all slots or those named."""
        rows = self.slots if slots is None else self.slots.filter(F.col("slot").isin(*slots))
        return self.add(rows.join(mapping, "oid").select(F.col("new_oid").alias("oid"), "slot", "value"))

    def multi_add(self, rows: DataFrame, primary: str, subs: list[str]) -> FrameStore:
        """FD:MULTI-ADD: a value that no sub-slot holds goes to the primary slot."""
        have = self.slots.filter(F.col("slot").isin(primary, *subs)).select("oid", "value").distinct()
        return self.add(rows.select("oid", "value").distinct().join(have, ["oid", "value"], "left_anti").withColumn("slot", F.lit(primary)))

    def multi_drop(self, rows: DataFrame, slots: list[str]) -> FrameStore:
        """FD:MULTI-DROP: a value goes from every one of the slots."""
        return self.drop(rows.select("oid", F.explode(F.array(*map(F.lit, slots))).alias("slot"), "value"))

    # computed slots

    def inverse_get(self, slot: str, inverse: str) -> DataFrame:
        """FD:INVERSE-GET, FD:INV-GET: stored values, and the frames whose inverse slot points here."""
        back = self.slots.filter(F.col("slot") == inverse).select(F.col("value").alias("oid"), F.col("oid").cast("string").alias("value"))
        return self.pget(slot).select(F.col("oid").cast("string").alias("oid"), "value").unionByName(back).distinct()

    def edges(self, *slots: str) -> DataFrame:
        return self.slots.filter(F.col("slot").isin(*slots)).select(F.col("oid").cast("string").alias("src"), F.col("value").alias("dst")).distinct()

    def get_star(self, roots: DataFrame, *slots: str) -> DataFrame:
        """GET*, FD:KLEENE-GET; empty without slots."""
        if not slots:
            return roots.select("root", F.col("root").alias("node")).limit(0)
        return closures.get_star(roots, self.edges(*slots))

    def inherit_values(self, roots: DataFrame, slot: str, through: str) -> DataFrame:
        return closures.inherit_values(roots, self.edges(through), self.get(slot).select(F.col("oid").cast("string").alias("oid"), "value"))

    def assoc_get(self, slot: str, key: str) -> DataFrame:
        """FD:ASSOC-GET on values "key=value": the values of entries whose key matches, whole, with any further "="."""
        entries = self.pget(slot).filter(F.col("value").startswith(f"{key}="))
        return entries.select("oid", F.col("value").substr(F.lit(len(key) + 2), F.length("value")).alias("value")).distinct()

    def car_get(self, slot: str) -> DataFrame:
        """FD:CAR-GET, FD:PAIRED-GET on values "car=cdr"; what is no pair counts itself."""
        return self.pget(slot).select("oid", F.substring_index("value", "=", 1).alias("value")).distinct()

    def assoc_test(self, slot: str, key: str, value: str) -> DataFrame:
        """FD:ASSOC-TEST: frames whose entry for the key has the value."""
        return self.assoc_get(slot, key).filter(F.col("value") == value).select("oid")

    def assoc_add(self, slot: str, key: str, rows: DataFrame) -> FrameStore:
        """FD:ASSOC-ADD: from (oid, value)."""
        return self.add(rows.select("oid", F.lit(slot).alias("slot"), F.concat(F.lit(f"{key}="), "value").alias("value")))

    def assoc_drop(self, slot: str, key: str, rows: DataFrame) -> FrameStore:
        """FD:ASSOC-DROP."""
        return self.drop(rows.select("oid", F.lit(slot).alias("slot"), F.concat(F.lit(f"{key}="), "value").alias("value")))

    def paired_test(self, slot: str, value: str) -> DataFrame:
        """FD:PAIRED-TEST, FD:CAR-TEST."""
        return self.car_get(slot).filter(F.col("value") == value).select("oid")

    def paired_drop(self, slot: str, rows: DataFrame) -> FrameStore:
        """FD:PAIRED-DROP: every pair that begins with a value, or the value itself."""
        gone = rows.select("oid", F.col("value").alias("_car")).distinct()
        cars = self.slots.filter(F.col("slot") == slot).withColumn("_car", F.substring_index("value", "=", 1))
        return self.drop(cars.join(gone, ["oid", "_car"], "left_semi"))

    def inverse_test(self, slot: str, inverse: str, value: str) -> DataFrame:
        """FD:INVERSE-TEST, FD:INV-TEST, FD:INV-GET."""
        return self.inverse_get(slot, inverse).filter(F.col("value") == value).select("oid")

    def cached_test(self, slot: str, value: str) -> DataFrame:
        """FD:CACHED-TEST, FD:CACHABLE-TEST."""
        return self.cachable_get(slot).filter(F.col("value") == value).select("oid")

    def with_adjunct(self, slot: str, rows: DataFrame) -> FrameStore:
        """FD:IX-GET, FD:IX-TEST, REGISTER-ADJUNCT!: a slot whose values lie in a table (oid, value) of their own."""
        return FrameStore(self.slots, self.computed | {slot: lambda _: rows.select("oid", "value")})

    def modify_frames(self, oids: DataFrame, slot: str, value: Column) -> FrameStore:
        """MODIFY-FRAME: new values of a slot, computed from the old, for given frames."""
        old = self.slots.filter(F.col("slot") == slot).join(oids.select("oid").distinct(), "oid", "left_semi")
        return self.set_(old.withColumn("value", value))

    def make_frames(self, oids: DataFrame, **slots: str) -> FrameStore:
        """MAKE-FRAME, FRAME-CREATE, NEW-FRAME: frames with the same given slots."""
        pairs = F.array(*(F.struct(F.lit(k).alias("slot"), F.lit(v).alias("value")) for k, v in slots.items()))
        return self.add(oids.select("oid", F.explode(pairs).alias("p")).select("oid", "p.slot", "p.value"))


def just_oids(values: DataFrame, pools: DataFrame, value: str = "value") -> DataFrame:
    """JUST-OIDS, OID?: values that are ids in one of the registered pools."""
    from .pools import get_pool

    ids = values.select(F.col(value).try_cast("long").alias("oid")).filter("oid is not null")
    return get_pool(ids, pools).select("oid")


def record_to_frame(oid: Column, record: Column, slots: list[str], parsers: dict[str, str] | None = None) -> list[Column]:
    """RECORD->FRAME: columns for a record (array of strings): empty strings are absent, parsers are SQL types."""
    out = [oid.alias("oid")]
    for i, s in enumerate(slots):
        v = F.nullif(F.get(record, F.lit(i)), F.lit(""))
        out.append((v.try_cast(parsers[s]) if parsers and s in parsers else v).alias(s))
    return out
