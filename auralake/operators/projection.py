"""Master sets as ADM descriptions and back, as selects and joins over tables of many sets.

Tables are keyed by `set`. beds: set, ix, id, channel. objects: set, ix, id. updates: set, id, at, and the fields of
EVENT_KEYS that a stream states (null: not stated). audio: set, channels, frames, rate. Times are samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions import geometry as G
from auralake.functions import speakers as P

# First free number of an id, type labels, the first id of an object that comes back.
FIRST_FREE, BED, OBJECT, FIRST_OBJECT = 0x1000, "0001", "0003", 10
#: Fields of an update that stay in force until stated again: column, type.
STATE = {"pos": "array<double>", "gain": "double", "active": "boolean", "size": "double", "rampLength": "long", "importance": "double", "snap": "boolean", "elevation": "boolean", "zones": "string", "screenFactor": "double", "depthFactor": "double"}


def elements(beds: DataFrame, objects: DataFrame) -> DataFrame:
    """set, track (from 1), bed, id, name: the bed's channels as listed, then the objects as listed."""
    b = beds.select("set", F.lit(0).alias("_kind"), "ix", "id", F.col("channel").alias("name"))
    o = objects.select("set", F.lit(1).alias("_kind"), "ix", "id", F.format_string("Object %d", "id").alias("name"))
    w = Window.partitionBy("set").orderBy("_kind", "ix", "id")
    return b.unionByName(o).select("set", F.row_number().over(w).alias("track"), (F.col("_kind") == 0).alias("bed"), "id", "name")


def element_ids(bed: Column, track: Column) -> dict[str, Column]:
    """The six ids that an element gets across the model."""
    kind, n, t = F.when(bed, BED).otherwise(OBJECT), (track + FIRST_FREE).cast("long"), track.cast("long")
    return {
        "channel_format": F.format_string("AC_%s%04X", kind, n), "pack_format": F.format_string("AP_%s%04X", kind, n), "stream_format": F.format_string("AS_%s%04X", kind, n),
        "track_format": F.format_string("AT_%s%04X_01", kind, n), "track_uid": F.format_string("ATU_%08X", t), "object": F.format_string("AO_%04X", n),
    }


def absolute_blocks(updates: DataFrame, keys: list[str], order: list[str], end: Column) -> DataFrame:
    """One block for each update, [start, until), with every field carried on: keys, ix (from 1), start, until, position,
    gain (linear), width, ramp, importance (0 to 10) and the hints of rendering.

    A gain that was stated is kept apart from whether the object is active: an inactive object has gain 0 and comes
    back at the level last stated, or none. A position that hasn't three parts clears the position. A block lasts
    until the next update, the last one to `end`, and none ends before it starts. A null time is 0.
    """
    at = F.coalesce("at", F.lit(0).cast("long"))
    u = updates.withColumn("at", at)
    u = u.withColumns({c: F.col(c) if c in u.columns else F.lit(None).cast(t) for c, t in STATE.items()})
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = w.rowsBetween(Window.unboundedPreceding, 0)
    last = {c: F.last(c, ignorenulls=True).over(kept) for c in STATE}
    gain = F.when(~F.coalesce(last["active"], F.lit(True)), 0.0).otherwise(P.decibels_to_linear(last["gain"]))
    return u.select(
        *keys, F.row_number().over(w).alias("ix"), F.col("at").alias("start"), F.greatest("at", F.coalesce(F.lead("at").over(w), end)).alias("until"),
        F.when(F.size(last["pos"]) == 3, last["pos"]).alias("position"), gain.alias("gain"), last["size"].alias("width"), F.coalesce(last["rampLength"], F.lit(0).cast("long")).alias("ramp"),
        P.half_away(last["importance"] * 10).cast("int").alias("importance"), F.coalesce(last["snap"], F.lit(False)).alias("snap"), F.coalesce(last["elevation"], F.lit(True)).alias("elevation"),
        F.coalesce(last["zones"], F.lit("all")).alias("zones"), F.coalesce(last["screenFactor"], F.lit(0.0)).alias("screen_factor"), F.coalesce(last["depthFactor"], F.lit(0.0)).alias("depth_factor"),
    )


def bed_blocks(elements: DataFrame, audio: DataFrame) -> DataFrame:
    """set, track, start, until, label, azimuth, elevation: a bed channel is one block over the whole programme. A name
    that is no bed channel's is written as it is, without a place."""
    e = elements.where("bed").join(audio.select("set", "frames"), "set")
    label = P.label_of_master(F.col("name"))
    return e.select("set", "track", F.lit(0).cast("long").alias("start"), F.col("frames").cast("long").alias("until"), F.coalesce(label, "name").alias("label"), P.azimuth_of_label(label).alias("azimuth"), P.elevation_of_label(label).alias("elevation"))


def to_adm(beds: DataFrame, objects: DataFrame, updates: DataFrame, audio: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """The tables of an ADM description: elements (with their ids), tracks (track, uid, track_format, pack_format),
    blocks of beds and of objects, packs, and notes; errors has the sets that are refused, as their elements
    aren't as many as the channels of their audio. No other table has a row of these.

    order: columns that put an object's updates in order. An object without updates has one silent block. The rate is
    the audio's; a stream that states another one gets a note (updates' column sample_rate, if there is one).
    """
    every = elements(beds, objects)
    counts = audio.select("set", "channels", "frames", "rate").join(every.groupBy("set").agg(F.count("*").alias("declared")), "set", "left").fillna(0, ["declared"])
    errors = counts.where("declared <> channels").select("set", F.format_string("%d elements declared, %d channels of audio", F.col("declared").cast("long"), F.col("channels").cast("long")).alias("error"))
    known = counts.where("declared = channels").select("set", "frames", "rate")
    e = every.join(known, "set")
    e = e.select("set", "track", "bed", "id", "name", "frames", *[c.alias(n) for n, c in element_ids(F.col("bed"), F.col("track")).items()])
    pack = F.when(F.col("bed"), F.lit(f"AP_{BED}{FIRST_FREE:04X}")).otherwise(F.col("pack_format"))
    own = e.where("not bed").select("set", "track", "id", "frames")
    moves = absolute_blocks(own.join(updates, ["set", "id"]), ["set", "track"], order, F.col("frames").cast("long"))
    still = own.join(updates.select("set", "id").distinct(), ["set", "id"], "left_anti")
    silent = still.select("set", "track", F.lit(1).alias("ix"), F.lit(0).cast("long").alias("start"), F.col("frames").cast("long").alias("until"), F.lit(0.0).alias("gain"))
    notes = [still.select("set", F.format_string("object %d has no events; a silent block is written", F.col("id").cast("long")).alias("note"))]
    notes.append(e.where(F.col("bed") & P.label_of_master(F.col("name")).isNull()).select("set", F.concat(F.lit("no speaker label for bed channel "), "name").alias("note")))
    if "sample_rate" in updates.columns:
        said = updates.groupBy("set").agg(F.max("sample_rate").alias("said")).join(known, "set").where("said <> rate")
        notes.append(said.select("set", F.format_string("the stream states %d Hz, the audio has %d", F.col("said").cast("long"), F.col("rate").cast("long")).alias("note")))
    all_notes = notes[0]
    for n in notes[1:]:
        all_notes = all_notes.unionByName(n)
    packs = e.groupBy("set", pack.alias("pack_format")).agg(F.max(F.when(F.col("bed"), F.lit("Bed")).otherwise(F.col("name"))).alias("name"), F.sort_array(F.collect_list("channel_format")).alias("channel_formats"))
    return {
        "elements": e, "tracks": e.select("set", "track", F.col("track_uid").alias("uid"), "track_format", pack.alias("pack_format")), "packs": packs,
        "bed_blocks": bed_blocks(e.select("set", "track", "bed", "name"), known), "object_blocks": moves.unionByName(silent, allowMissingColumns=True), "notes": all_notes, "errors": errors,
    }


def _place(blocks: DataFrame) -> Column:
    if "cartesian" not in blocks.columns:
        return F.col("position")
    polar = G.polar_to_cube(*[F.col("position")[i] for i in range(3)])
    return F.when(F.coalesce("cartesian", F.lit(True)), F.col("position")).otherwise(F.array(polar["x"], polar["y"], polar["z"]))


def block_events(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Updates of blocks, nothing left unstated: keys, at, active, pos, size, importance, gain (decibels), rampLength.
    A polar position (azimuth, elevation, distance; column cartesian false) is turned into a place in the room."""
    place = _place(blocks)
    return blocks.select(
        *keys, F.coalesce("start", F.lit(0).cast("long")).alias("at"), F.lit(True).alias("active"), F.when(F.col("position").isNotNull(), place).alias("pos"), F.col("width").alias("size"),
        (F.col("importance") / 10).alias("importance"), P.linear_to_decibels(F.col("gain")).alias("gain"), F.col("ramp").alias("rampLength"),
    )


def keyframes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Where and how loud an object is from each block on: keys, at, position, gain (1 if not stated), ramp, spread (0 to
    1), importance (0 to 1, 1 if not stated) and mode; blocks without a position are left out."""
    place = _place(blocks)

    def share(c: Column, missing: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(missing))))

    mode = F.struct(
        F.coalesce("snap", F.lit(False)).alias("snap"), F.coalesce(P.zone_code(F.col("zones")), F.lit(0)).alias("zones"), F.coalesce("elevation", F.lit(True)).alias("elevation"),
        P.screen_codes(F.col("screen_factor"), F.col("depth_factor")).alias("screen"),
    )
    return blocks.where("position is not null").select(
        *keys, F.coalesce("start", F.lit(0).cast("long")).alias("at"), place.alias("position"), F.coalesce("gain", F.lit(1.0)).alias("gain"), F.coalesce("ramp", F.lit(0).cast("long")).alias("ramp"),
        share(F.col("width"), 0.0).alias("spread"), share(F.col("importance") / 10, 1.0).alias("importance"), mode.alias("mode"),
    )


def parts(tracks: DataFrame, key: str = "set") -> DataFrame:
    """set, place (from 0), kind (lfe, bed, object), track, name and error: the low frequency channel first, then beds
    and objects in the order of tracks. tracks: set, track, kind (beds: DirectSpeakers, objects: Objects), label. Other
    kinds are left out. A second low frequency channel, or a bed whose label names no speaker, is an error."""
    known = tracks.where(F.col("kind").isin("DirectSpeakers", "Objects"))
    name = F.coalesce(P.master_of_label(F.col("label")), F.when(P.label_of_master(F.col("label")).isNotNull(), F.col("label")))
    low = (F.col("kind") == "DirectSpeakers") & F.coalesce(P.is_lfe(F.col("label")), F.lit(False))
    p = known.select(key, "track", F.when(low, "lfe").when(F.col("kind") == "Objects", "object").otherwise("bed").alias("part"), name.alias("name"))
    w = Window.partitionBy(key).orderBy((F.col("part") != "lfe").cast("int"), "track")
    nth = F.row_number().over(Window.partitionBy(key, "part").orderBy("track"))
    error = F.when((F.col("part") == "lfe") & (nth > 1), "a second low frequency channel").when((F.col("part") == "bed") & F.col("name").isNull(), "a bed channel without a place")
    return p.select(key, (F.row_number().over(w) - 1).alias("place"), F.col("part").alias("kind"), "track", F.when(F.col("part") != "object", F.col("name")).alias("name"), error.alias("error"))


def to_master(tracks: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """beds, objects, events and errors of a description. tracks: set, track, kind, label, entries (how many elements
    the track carries, 1 but in faulty files). blocks: set, track and what block_events() reads.

    A track without an entry is left out; one with several, or of another kind than beds and objects, is an error. Bed
    channels keep the ids of their names (others are numbered in order), objects get ids from FIRST_OBJECT on in the
    order of tracks, events are in order of time, then id.
    """
    bad = (F.col("entries") > 1) | ((F.col("entries") == 1) & ~F.col("kind").isin("DirectSpeakers", "Objects"))
    errors = tracks.where(bad).select("set", "track", F.when(F.col("entries") > 1, "several elements on a track").otherwise("audio of a kind that a master has no place for").alias("error"))
    good = tracks.where("entries = 1").join(errors.select("set").distinct(), "set", "left_anti")
    w = Window.partitionBy("set", "kind").orderBy("track")
    numbered = good.withColumn("_n", F.row_number().over(w) - 1)
    name = F.coalesce(P.master_of_label(F.col("label")), F.coalesce("label", F.lit("")))
    beds = numbered.where("kind = 'DirectSpeakers'").select("set", F.col("_n").alias("ix"), F.coalesce(P.id_of_master(name), F.col("_n")).cast("long").alias("id"), name.alias("channel"))
    objects = numbered.where("kind = 'Objects'").select("set", "track", F.col("_n").alias("ix"), (F.col("_n") + FIRST_OBJECT).cast("long").alias("id"))
    moved = block_events(blocks.join(objects.select("set", "track", "id"), ["set", "track"]), ["set", "id"])
    still = beds.select("set", "id", F.lit(0).cast("long").alias("at"), F.lit(True).alias("active"), F.lit(0.0).alias("gain"))
    return {"beds": beds, "objects": objects.drop("track"), "events": in_time_order(moved.unionByName(still, allowMissingColumns=True)), "errors": errors}


def in_time_order(events: DataFrame) -> DataFrame:
    """Events of a set with their place in order of time, then id: seq, from 0. Ties beyond that keep no order."""
    w = Window.partitionBy("set").orderBy(F.coalesce("at", F.lit(0).cast("long")), F.coalesce("id", F.lit(0).cast("long")))
    return events.withColumn("seq", F.row_number().over(w) - 1)
