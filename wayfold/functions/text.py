"""Prompt and identifier text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wording of prompts and descriptions, and the limits at which it changes.
POINT_TEMPLATES = ["Please walk towards the goal (%.1f, %.1f).", "Walk to the point (%.1f, %.1f).", "Navigate to (%.1f, %.1f)."]
LANGUAGE_TEMPLATES = ["Walk to %s.", "Go to %s.", "Head towards %s."]
LANGUAGE_POINT_SUFFIX = " It is at (%.1f, %.1f)."
EMBODIMENT_TAGS = {"person_walking": "a human walking", "wheeled_robot": "a robot", "legged_robot": "a robot", "simulated_agent": "a robot"}
EMBODIMENT_TEMPLATE = "The camera is carried by %s. The past views are sampled at %s Hz. Please predict the next %d positions at %s Hz."
KNOWN_HEIGHT_SOURCES = ["dataset", "simulator"]
FIELD_OF_VIEW = {"unknown": "The camera's field of view is unknown", "horizontal": "The camera's horizontal field of view is %.0f degrees", "vertical": " and its vertical field of view %.0f degrees"}
CAMERA_HEIGHT = {"known": "; it is mounted %.2f m above the ground.", "unknown": "; its height above the ground is unknown."}
VIEW_LABELS = {"before": "View %d s ago:", "now": "View now:", "after": "View in %d s:"}
HISTORY = {"start": "Frame interval %.1f s. Current speed %.2f m/s.", "positions": "Robot positions over the last %d frames, oldest first: %s.", "position": "(%.1f, %.1f)", "instruction": "Instruction: %s", "goal": "Goal: (%.1f, %.1f).", "ask": "Predict the robot's position at each of the next %d frames."}
PACES = [(0.15, "stands still"), (0.5, "moves very slowly"), (1.0, "moves at a slow walking pace"), (1.8, "moves at walking pace"), (None, "moves fast")]
PACE_CHANGES = {"rest": 0.15, "much": 0.3, "stop": "stops", "start": "starts moving", "slower": "slows down", "faster": "speeds up", "steady": "keeps a steady speed"}
TURNS = [(15, "goes straight ahead"), (45, "bears {side} by about {degrees} degrees"), (120, "turns sharply {side}, about {degrees} degrees"), (None, "turns around to the {side}")]
IN_WORDS, TOO_SHORT_TO_TURN = "the carrier %s, %s, and %s", 0.3
INSTRUCTION_LABELS = {"description": "Task", "place": "Place", "interaction": "Reacts to", "instruction": "Task"}


def scenario_id(dataset: Column, sequence: Column, segment: Column, frame: Column) -> Column:
    return F.concat_ws("_", dataset, sequence, F.lpad(segment.cast("string"), 2, "0"), F.lpad(frame.cast("string"), 6, "0"))


def request_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 32)


def lower_first(c: Column) -> Column:
    """Trimmed, without full stops behind, the first letter in lower case unless the first word is all capitals."""
    text = F.regexp_replace(F.trim(c), r"\.+$", "")
    return F.when(text.rlike(r"^(?=[^\s]*\p{Lu})[^\s\p{Ll}]{2,}(\s|$)"), text).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)))


def _chosen(templates: list[str], number: Column, *values: Column) -> Column:
    out = F.format_string(templates[-1], *values)
    for k in range(len(templates) - 2, -1, -1):
        out = F.when(number == k, F.format_string(templates[k], *values)).otherwise(out)
    return out


def point_prompt(x: Column, y: Column, template: Column) -> Column:
    """Prompt for a goal given as a point, by the number of its template."""
    return _chosen(POINT_TEMPLATES, template, x, y)


def language_prompt(instruction: Column, template: Column, x: Column, y: Column, with_point: Column) -> Column:
    """Prompt for a goal given in words, with its place behind where that is wanted."""
    return F.concat(_chosen(LANGUAGE_TEMPLATES, template, lower_first(instruction)), F.when(with_point, F.format_string(LANGUAGE_POINT_SUFFIX, x, y)).otherwise(F.lit("")))


def embodiment_prompt(body: Column, past_hz: str = "1", n: int = 10, out_hz: str = "2") -> Column:
    tag = F.coalesce(*(F.when(body == k, F.lit(v)) for k, v in EMBODIMENT_TAGS.items()), F.lit("a robot"))
    return F.format_string(EMBODIMENT_TEMPLATE, tag, F.lit(past_hz), F.lit(n), F.lit(out_hz))


def camera_sentence(h_fov: Column, v_fov: Column, height: Column, source: Column) -> Column:
    """Field of view and height of a camera as far as they are known for certain."""
    tall = F.when(v_fov.isNull(), F.lit("")).otherwise(F.format_string(FIELD_OF_VIEW["vertical"], v_fov))
    wide = F.when(h_fov.isNull(), F.lit(FIELD_OF_VIEW["unknown"])).otherwise(F.concat(F.format_string(FIELD_OF_VIEW["horizontal"], h_fov), tall))
    known = height.isNotNull() & ~F.isnan(height) & F.coalesce(source.isin(KNOWN_HEIGHT_SOURCES), F.lit(False))
    return F.concat(wide, F.when(known, F.format_string(CAMERA_HEIGHT["known"], height)).otherwise(F.lit(CAMERA_HEIGHT["unknown"])))


def view_label(offset: Column) -> Column:
    return F.when(offset < 0, F.format_string(VIEW_LABELS["before"], -offset)).when(offset > 0, F.format_string(VIEW_LABELS["after"], offset)).otherwise(F.lit(VIEW_LABELS["now"]))


def history_prompt(rate: Column, speed: Column, points: Column, instruction: Column, goal_x: Column, goal_y: Column, horizon: int) -> Column:
    """Interval, speed, positions (an array of x, y), goal and task of a scenario as text."""
    listed = F.array_join(F.transform(points, lambda p: F.format_string(HISTORY["position"], p["x"], p["y"])), ", ")
    parts = [
        F.format_string(HISTORY["start"], 1.0 / rate, speed),
        F.when(F.size(points) > 0, F.format_string(HISTORY["positions"], F.size(points) - 1, listed)),
        F.when(instruction.isNotNull(), F.format_string(HISTORY["instruction"], F.trim(instruction))).otherwise(F.format_string(HISTORY["goal"], goal_x, goal_y)),
        F.format_string(HISTORY["ask"], F.lit(horizon)),
    ]
    return F.concat_ws(" ", *parts)


def instruction_text(**fields: Column) -> Column:
    """Fields that are not empty, each with its label, as sentences."""
    said = []
    for name, c in fields.items():
        text = F.regexp_replace(F.trim(c), r"\.+$", "")
        said.append(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{INSTRUCTION_LABELS.get(name, name.capitalize())}: "), text, F.lit("."))))
    return F.concat_ws(" ", *said)


def path_in_words(metres: Column, first: Column, last: Column, bearing: Column, seconds: float = 5.0) -> Column:
    """Pace, change of speed and turn of a path; first and last are the metres of its first and last second."""
    speed, b = metres / seconds, F.when(metres > TOO_SHORT_TO_TURN, bearing).otherwise(0.0)
    filled = {"{side}": F.when(b > 0, "left").otherwise("right"), "{degrees}": F.format_string("%.0f", F.abs(b))}

    def first_below(value: Column, limits: list) -> Column:
        """The words of the first limit that the value is below; those of the last entry beyond all limits."""
        out = F.lit(limits[-1][1])
        for limit, words in limits[-2::-1]:
            out = F.when(value < limit, words).otherwise(out)
        return out

    turn = first_below(F.abs(b), TURNS)
    for mark, words in filled.items():
        turn = F.replace(turn, F.lit(mark), words)
    rest, much = PACE_CHANGES["rest"], PACE_CHANGES["much"]
    change = F.when((last < rest) & (first > rest), PACE_CHANGES["stop"]).when((first < rest) & (last > rest), PACE_CHANGES["start"]).when(last < first - much, PACE_CHANGES["slower"]).when(last > first + much, PACE_CHANGES["faster"]).otherwise(PACE_CHANGES["steady"])
    return F.format_string(IN_WORDS, first_below(speed, PACES), change, turn)


def json_in_text(c: Column, schema: str) -> Column:
    """The JSON object inside free text, parsed; null fields where it does not parse."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)


def answer_fields(c: Column) -> Column:
    """description, place and interaction from an answer; the whole text as description where it holds no JSON."""
    found = json_in_text(c, "description string, place string, interaction string")
    ok = F.coalesce(found["description"], found["place"], found["interaction"]).isNotNull()
    field = lambda n: F.trim(F.coalesce(found[n], F.lit("")))
    return F.struct(F.when(ok, field("description")).otherwise(F.trim(c)).alias("description"), F.when(ok, field("place")).otherwise("").alias("place"), F.when(ok, field("interaction")).otherwise("").alias("interaction"), c.alias("raw"))


def recording_of(path: Column, part: int = -1) -> Column:
    return F.element_at(F.split(path, "/"), part)


def group_key(c: Column) -> Column:
    """A recording's name without its last underscore part."""
    return F.regexp_replace(c, r"_[^_]*$", "")
