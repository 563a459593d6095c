"""Name suggestions for notices without a confirmed golden row.

The similarity is the sequence ratio 2*M/T of the normalised names, which no
built-in computes; one Arrow-fed task function scores it.  Around it Spark does
the work: distinct names only, partitioned into length bands (a pair can reach
the threshold only if the lengths are close, so bands lose nothing), band
sides cut into bounded blocks by their counted sizes, and a top-k merge.
Inside a block an index of bigrams with their positions leaves few golden names,
their longest common subsequences bound the ratio, and only names whose bound
reaches the third best so far are scored.  No pair of rows is ever materialised outside a task, only its best k.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill import vocab
from noticemill.functions.scale import salted_join
from noticemill.operators.reconciliation import Golden
from noticemill.session import scratch_path

BAND = 8
# Golden names and asked names of a block at most.
BLOCK_ROWS = 20_000
ASKED_ROWS = 4_000
WORD = 64
_T = vocab.FUZZY_THRESHOLD


def ratio(notice: str, golden: str) -> float:
    """Sequence ratio; the order of the two names matters."""
    return SequenceMatcher(None, notice, golden).ratio()


class GramIndex:
    """Positional bigram index of the golden names of a block.

    The M matched characters of two names are a common subsequence.  With at
    least M0 = t*(a+b)/2 of them, a-M0 characters of one name and b-M0 of the
    other stay unmatched; every one of these parts at most one pair of
    neighbours of the subsequence, so M0-1-(a-M0)-(b-M0) common bigrams are
    left, and no matched bigram is shifted by more than the unmatched
    characters before it.  Names with fewer bigrams in reach cannot score.
    """

    def __init__(self, names: list[str]):
        self.lengths = np.array([len(n) for n in names], np.int64)
        found: dict[str, tuple[list[int], list[int]]] = {}
        for row, name in enumerate(names):
            for place in range(len(name) - 1):
                rows, places = found.setdefault(name[place:place + 2], ([], []))
                rows.append(row)
                places.append(place)
        self.postings = {g: (np.array(r, np.int64), np.array(p, np.int64)) for g, (r, p) in found.items()}

    def candidates(self, name: str) -> np.ndarray:
        """Rows of the names that may reach the threshold with this one."""
        matched = np.ceil(_T * (len(name) + self.lengths) / 2 - 1e-9).astype(np.int64)
        spare, other = len(name) - matched, self.lengths - matched
        needed = matched - 1 - spare - other
        common = np.zeros(len(self.lengths), np.int64)
        for place in range(len(name) - 1):
            rows, places = self.postings.get(name[place:place + 2], (None, None))
            if rows is None:
                continue
            shift = places - place
            near = rows[(shift <= other[rows]) & (-shift <= spare[rows])]
            # Rows of a posting are ascending: a name counts once for each bigram of the asked one.
            common[near[np.flatnonzero(np.diff(near, prepend=-1))]] += 1
        return np.flatnonzero((common >= needed) & (spare >= 0) & (other >= 0))


class Subsequences:
    """Longest common subsequences of one name with many, all rows at once.

    The positions of every character in a golden name are the bits of one word; a step per character of the asked name
    then moves the ends of the subsequence in all rows (bit-parallel recurrence).  The matched characters of the ratio
    are a common subsequence, so this length bounds them.  Names beyond a word's bits get their own length.
    """

    def __init__(self, names: list[str]):
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.long = self.lengths > WORD
        places: dict[str, tuple[list[int], list[int]]] = {}
        for row, name in enumerate(names):
            for place, letter in enumerate(name[:WORD]):
                rows, bits = places.setdefault(letter, ([], []))
                rows.append(row)
                bits.append(1 << place)
        self.masks = {}
        for letter, (rows, bits) in places.items():
            mask = np.zeros(len(names), np.uint64)
            np.bitwise_or.at(mask, np.array(rows, np.int64), np.array(bits, np.uint64))
            self.masks[letter] = mask

    def common(self, name: str, rows: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence with each of the rows, or more for names beyond a word."""
        open_ = np.full(len(rows), np.iinfo(np.uint64).max, np.uint64)
        taken = {letter: self.masks[letter][rows] for letter in set(name) if letter in self.masks}
        for letter in name:
            if letter in taken:
                met = open_ & taken[letter]
                open_ = (open_ + met) | (open_ - met)
        return np.where(self.long[rows], np.minimum(self.lengths[rows], len(name)), np.bitwise_count(~open_).astype(np.int64))


def _best_of_block(names: pd.DataFrame, golden: pd.DataFrame) -> pd.DataFrame:
    """Best k golden rows of this block for each of its names."""
    out = []
    if len(names) and len(golden):
        known = golden["golden_name"].tolist()
        index, bounds = GramIndex(known), Subsequences(known)
        issuers, positions = golden["issuer"].tolist(), golden["position"].tolist()
        tie = np.empty(len(known), np.int64)
        tie[sorted(range(len(known)), key=lambda j: (issuers[j], positions[j]))] = np.arange(len(known))
        for name in names["name"]:
            rows = index.candidates(name)
            most = 2.0 * bounds.common(name, rows) / (len(name) + bounds.lengths[rows])
            rows, most = rows[most >= _T], most[most >= _T]
            best: list[tuple[float, str, int]] = []
            # Best bound first: once it, with its tie order, comes after the last of the best, so does all that follows.
            for i in np.lexsort((tie[rows], -most)):
                j = rows[i]
                if len(best) == vocab.FUZZY_TOP and (-most[i], issuers[j], positions[j]) > best[-1]:
                    break
                score = ratio(name, known[j])
                if score >= _T:
                    best = sorted([*best, (-score, issuers[j], int(positions[j]))])[: vocab.FUZZY_TOP]
            out.extend((name, -score, issuer, position) for score, issuer, position in best)
    return pd.DataFrame(out, columns=["name", "score", "issuer", "position"])


def suggestions(names: DataFrame, golden: Golden) -> DataFrame:
    """(name, rank, score, issuer, position): best golden rows per distinct name.

    ``names`` has one column ``name`` of normalised issuer names.
    """
    asked = names.where("name is not null").distinct().withColumn("_len", F.length("name"))
    rows = golden.rows.where("n_issuer is not null").select(
        F.col("n_issuer").alias("golden_name"), F.col("record.issuer").alias("issuer"), "position",
        F.floor(F.length("n_issuer") / F.lit(BAND)).cast("int").alias("band"),
    )
    # Lengths that can pair with length L lie in [L*t/(2-t), L*(2-t)/t].
    low, high = _T / (2 - _T), (2 - _T) / _T
    banded = asked.withColumn(
        "band",
        F.explode(
            F.sequence(
                F.floor(F.col("_len") * low / BAND).cast("int"), F.floor(F.col("_len") * high / BAND).cast("int")
            )
        ),
    ).drop("_len")
    # Bounded blocks: per band, how many pieces each side is cut into.
    name_parts = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / ASKED_ROWS).cast("int").alias("names_n"))
    golden_parts = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("golden_n"))
    parts = name_parts.join(golden_parts, "band")
    left = banded.join(parts, "band").select(
        "band",
        "name",
        F.pmod(F.xxhash64("name"), F.col("names_n")).cast("int").alias("names_part"),
        F.explode(F.sequence(F.lit(0), F.col("golden_n") - 1)).alias("golden_part"),
    )
    right = rows.join(parts, "band").select(
        "band",
        "golden_name",
        "issuer",
        "position",
        F.explode(F.sequence(F.lit(0), F.col("names_n") - 1)).alias("names_part"),
        F.pmod(F.xxhash64("position"), F.col("golden_n")).cast("int").alias("golden_part"),
    )
    block = ["band", "names_part", "golden_part"]
    # The work of a block does not show in its bytes: a given number of partitions is not merged into a few.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = (
        left.repartition(tasks, *block)
        .groupBy(*block)
        .cogroup(right.repartition(tasks, *block).groupBy(*block))
        .applyInPandas(_best_of_block, "name string, score double, issuer string, position long")
    )
    # At most k rows per block reach this merge.
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "issuer", "position")))
    top = best.groupBy("name").agg(F.slice(ordered, 1, vocab.FUZZY_TOP).alias("top"))
    return top.select("name", F.posexplode("top").alias("rank", "t")).select(
        "name", (F.col("rank") + 1).alias("rank"), (-F.col("t.s")).alias("score"), "t.issuer", "t.position"
    )


def possible_matches(records: DataFrame, golden: Golden) -> DataFrame:
    """(document_id, rank, score, issuer, position) for unconfirmed records.

    ``records`` are reconciled with ``keep_key`` (column key_issuer).  A strong
    identifier conflict already lists its candidates and gets no suggestions.
    """
    open_ = records.where(
        "reference_validation.reference_record is null and size(reference_validation.conflicts) = 0 "
        "and key_issuer is not null"
    ).select("document_id", F.col("key_issuer").alias("name"))
    # Read twice below: written once, the lookups behind it run once.
    path = scratch_path(records.sparkSession, "open-names")
    open_.write.parquet(path)
    open_ = records.sparkSession.read.schema(open_.schema).parquet(path)
    return salted_join(open_, suggestions(open_.select("name"), golden), ["name"], ["document_id"], "inner").drop("name")


def attach_suggestions(records: DataFrame, golden: Golden) -> DataFrame:
    """Put the suggestions into reference_validation.possible_matches."""
    found = possible_matches(records, golden)
    rows = golden.rows.select("position", "record")
    listed = found.join(rows, "position").groupBy("document_id").agg(
        F.expr("transform(array_sort(collect_list(struct(rank, record))), r -> r.record)").alias("_suggested")
    )
    joined = records.join(listed, "document_id", "left")
    return joined.withColumn(
        "reference_validation",
        F.expr(
            "if(_suggested is null, reference_validation, named_struct("
            "'exact_match', reference_validation.exact_match, 'matched_by', reference_validation.matched_by, "
            "'reference_record', reference_validation.reference_record, "
            "'conflicts', reference_validation.conflicts, 'possible_matches', _suggested))"
        ),
    ).drop("_suggested")
