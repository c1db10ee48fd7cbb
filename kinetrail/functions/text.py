"""Prompt templates and text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinetrail.operators.annotations import adjacent_distinct


def action_prompt(language: Column, images: Column) -> Column:
    """Fixed wording: image marks and the question for an action."""
    return F.concat(F.repeat(F.lit("<image>"), images), F.lit("\nWhat action should the robot take to "), F.lower(F.trim(language)), F.lit("?"))


def scene_instruction(language: Column) -> Column:
    """Without closing punctuation, in lower case, on one line; a fixed phrase where nothing is left."""
    x = F.lower(F.regexp_replace(F.coalesce(language, F.lit("")), r"\p{Punct}+$", ""))
    return F.when(x == "", "interact with any object").otherwise(F.replace(x, F.lit("\n"), F.lit(" ")))


def episode_elements(history: int, prompt: Column, thought: Column | None, goal: bool) -> Column:
    """Array of elements of an episode step: images, prompt, thought and goal image (with loss, if asked for), action."""

    def el(kind: str, loss: int, text: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(loss).alias("has_loss"), (F.lit(None).cast("string") if text is None else text).alias("text"))

    parts = [el("image", 0)] * history + [el("text", 0, prompt)]
    if thought is not None:
        parts.append(el("text", 1, thought))
    if goal:
        parts.append(el("goal_image", 1))
    return F.array(*parts, el("action", 1))


def between_marks(text: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """What stands between the first start mark and the first end mark."""
    return F.get(F.split(F.get(F.split(text, "\\Q" + end + "\\E"), F.lit(0)), "\\Q" + start + "\\E"), F.lit(1))


def before_nul(text: Column) -> Column:
    return F.substring_index(text, "\x00", 1)


def arms_thought(left: Column, right: Column) -> Column:
    """Fixed wording: what each arm does over a chunk, from arrays of cleaned labels; empty ones and repeats of the one before are left out."""

    def arm(x: Column) -> Column:
        said = adjacent_distinct(x)
        return F.when(F.size(said) == 0, "none").otherwise(F.array_join(said, ", "))

    return F.concat(F.lit("[LEFT]: "), arm(left), F.lit("; [RIGHT]: "), arm(right))


def subtask_thought(plan: Column, subtask: Column, left: Column, right: Column) -> Column:
    """Fixed wording: plan, subtask and movement between their marks."""

    def part(name: str, body: Column) -> Column:
        return F.concat(F.lit(f"<|{name}|>\n"), body, F.lit(f"\n<|\\ {name}|>\n\n"))

    movement = F.concat(F.lit("[LEFT]: "), left, F.lit("\n[RIGHT]: "), right, F.lit("\n"))
    return F.concat(F.lit("\n"), part("plan", plan), part("subtask", subtask), part("movement", movement))


def _described(x: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("No action."))


def subtasks_prompt(opening: str, context: Column, frames: Column, trajectory: bool, rules: str) -> Column:
    """The question for an episode's subtasks: opening, context (if it says anything), one block for each frame and the rules. frames: array of (frame, left, right) in order. With
    trajectory, an image of the whole motion follows the frames' images."""
    goal = F.when(F.length(F.trim(context)) > 0, F.concat(F.lit("The overall goal of the task is: "), context, F.lit("\n\n"))).otherwise("")
    motion = F.concat(F.lit("- Image "), F.size(frames) + 1, F.lit(": Global motion trajectories of both arms over the entire task\n\n")) if trajectory else F.lit("")
    block = lambda x, i: F.concat(F.lit("Frame "), x["frame"], F.lit(":\n- Frame image: image "), i + 1, F.lit("\n- Left arm action: "), _described(x["left"]), F.lit("\n- Right arm action: "), _described(x["right"]), F.lit("\n\n"))
    return F.concat(F.lit(opening), goal, motion, F.lit("Per-frame image and arm actions (low-level, DO NOT copy these!):\n"), F.array_join(F.transform(frames, block), ""), F.lit(rules))


def segments_prompt(opening: str, context: Column, frames: Column, subtasks: Column, rules: str) -> Column:
    """The second question, which spreads known subtasks over the frames: opening, goal, the subtasks by number, one line for each frame and the rules."""
    goal = F.when(F.length(F.trim(context)) > 0, F.concat(F.lit("My Overall Final Goal: "), context, F.lit("\n\n"))).otherwise("")
    known = F.array_join(F.transform(subtasks, lambda s, i: F.concat(i + 1, F.lit(". "), s, F.lit("\n"))), "")
    line = lambda x: F.concat(F.lit("- Frame "), x["frame"], F.lit(": Left: "), _described(x["left"]), F.lit("; Right: "), _described(x["right"]), F.lit("\n"))
    count = F.concat(F.lit("Input sequence: "), F.size(frames), F.lit(" frames of my visual sensors and internal state.\n"))
    return F.concat(F.lit(opening), goal, count, F.lit("\n### MY PLANNED SUBTASK SEQUENCE:\n"), known, F.lit("\n### MY REGISTERED LOW-LEVEL ARM ACTIONS (Ground Truth):\n"), F.array_join(F.transform(frames, line), ""), F.lit(rules))
