"""Standardisation of source datasets as data: an action is a list of parts, built by one function.

A part names a column of the source and what to take of it:
  take(column, start, stop)   elements start..stop (Python slices, negative from the end); a scalar counts as an array of one
  clip, invert, cast          changes of the part's values: clip to [0, 1], 1 - x, boolean to number
  zeros(n), ones(n), like     padding
  binarize, relative          gripper clean-ups over the trajectory (need the step window)
A part of the action looks for its column on the action's side first, a part of a state on the observation's: as a field of a struct so named, else with the
side as a prefix (action_x, observation_x), else under its own name. So one name may serve both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from kinetrail.operators import stats, windows
from kinetrail.operators.registry import TRANSFORMS


@dataclass(frozen=True)
class Part:
    column: str | None = None
    start: int | None = None
    stop: int | None = None
    op: str = ""  # "", clip, invert, clip_invert, zeros, ones, binarize, relative, euler
    n: int = 0


def take(column: str, start: int | None = None, stop: int | None = None, op: str = "") -> Part:
    return Part(column, start, stop, op)


def zeros(n: int) -> Part:
    return Part(op="zeros", n=n)


def ones(n: int) -> Part:
    return Part(op="ones", n=n)


@dataclass(frozen=True)
class Spec:
    """action: parts; state: named parts; drop: first steps to drop; relabel: dimensions taken from the next state's difference; language: column copied."""

    action: tuple[Part, ...] = ()
    state: tuple[tuple[str, tuple[Part, ...]], ...] = ()
    drop: bool = False
    relabel: str | None = None
    language: str | None = None


A, S = "action", "state"
WV, RD, OG, GC = "world_vector", "rotation_delta", "open_gripper", "gripper_closedness_action"
L = "natural_language_instruction"
EEF6 = (("EEF_state", (take(S, 0, 6),)), ("gripper_state", (take(S, -1),)))
INVERTED = (take(A, 0, 6), take(A, -1, None, "clip_invert"))

#: The parts of each source's actions and states, by name.
SPECS: dict[str, Spec] = {
    "bridge_oxe": Spec((take(WV), take(RD), take(OG)), EEF6, drop=True, relabel=S, language=L),
    "bridge_orig": Spec((take(A, 0, 6), take(A, -1, None, "binarize")), EEF6, drop=True, relabel=S),
    "ppgm": Spec((take(A, 0, 6), take(A, -1, None, "binarize")), (("EEF_state", (take("cartesian_position", 0, 6),)), ("gripper_state", (take("gripper_position", -1),)))),
    "rt1": Spec((take(WV), take(RD), take(GC, op="relative")), language=L),
    "kuka": Spec((take(WV), take(RD), take(GC, op="relative")), language=L),
    "taco_play": Spec((take("rel_actions_world", 0, 6), take("rel_actions_world", -1, None, "clip")), (("state_eef", (take("robot_obs", 0, 6),)), ("state_gripper", (take("robot_obs", 7, 8),))), language=L),
    "jaco_play": Spec((take(WV), zeros(3), take(GC, op="relative")), (("state_eef", (take("pos", 0, 6),)), ("state_gripper", (take("pos", -1),))), language=L),
    "berkeley_cable_routing": Spec((take(WV), take(RD), zeros(1)), language=L),
    "roboturk": Spec((take(WV), take(RD), take(GC, op="clip_invert")), language=L),
    "nyu_door_opening": Spec((take(WV), take(RD), take(GC, op="relative")), language=L),
    "viola": Spec((take(WV), take(RD), take(GC, op="clip_invert")), language=L),
    "berkeley_autolab_ur5": Spec((take(WV), take(RD), take(GC, op="relative")), ((S, (take("robot_state", 6, 14),)),), language=L),
    "toto": Spec((take(WV), take(RD), take(OG)), language=L),
    "language_table": Spec((take(A), zeros(4), ones(1))),
    "pusht": Spec((take(WV), take(RD), take(GC)), language=L),
    "stanford_kuka_multimodal": Spec((take(A, 0, 3), zeros(3), take(A, -1))),
    "nyu_rot": Spec((take(A, 0, 7),), (("eef_state", (take(S, 0, 6),)), ("gripper_state", (take(S, -1),)))),
    "stanford_hydra": Spec((take(A, 0, 6), take(A, -1, None, "invert")), (("eef_state", (take(S, 0, 3), take(S, 7, 10))), ("gripper_state", (take(S, -3, -2),)))),
    "austin_buds": Spec(INVERTED, ((S, (take(S, 0, 8),)),)),
    "nyu_franka_play": Spec((take(A, -8, -2), take(A, -2, -1, "clip")), (("eef_state", (take(S, -6),)),)),
    "maniskill": Spec((take(A),), (("gripper_state", (take(S, 7, 8),)),)),
    "furniture_bench": Spec((take(A, 0, 3), take(A, 3, 7, "euler"), take(A, -1, None, "clip_invert")), ((S, (take(S, 0, 7), take(S, -1))),)),
    "cmu_franka_exploration": Spec((take(A, 0, -1),)),
    "imperial_wristcam": Spec((take(A, 0, -1),)),
    "ucsd_kitchen": Spec((take(A, 0, -1),), (("joint_state", (take(S, 0, 7),)),)),
    "ucsd_pick_place": Spec((take(A, 0, 3), zeros(3), take(A, -1)), EEF6),
    "austin_sailor": Spec(INVERTED),
    "austin_sirius": Spec(INVERTED),
    "bc_z": Spec((take("xyz_residual", 0, 3), take("axis_angle_residual", 0, 3), take("target_close", 0, 1, "invert")), language=L),
    "tokyo_pr2_opening_fridge": Spec((take(A, 0, -1),), EEF6),
    "tokyo_pr2_tabletop": Spec((take(A, 0, -1),), EEF6),
    "utokyo_xarm_pick_place": Spec((take(A),)),
    "utokyo_xarm_bimanual": Spec((take(A, -7),)),
    "berkeley_mvp": Spec((take(A),)),
    "berkeley_rpt": Spec((take(A),)),
    "dlr_sara_pour": Spec((take(A),)),
    "robo_net": Spec((take(A, 0, 4), zeros(2), take(A, -1)), (("eef_state", (take(S, 0, 4), zeros(2))), ("gripper_state", (take(S, -1),)))),
    "kaist_nonprehensible": Spec((take(A, 0, 6), zeros(1)), ((S, (take(S, -7),)),)),
    "stanford_mask_vit": Spec((take(A, 0, 4), zeros(2), take(A, -1)), (("eef_state", (take("end_effector_pose", 0, 4), zeros(2))), ("gripper_state", (take("end_effector_pose", -1),)))),
    "tokyo_lsmo": Spec((take(A),), EEF6),
    "robocook": Spec((take(A),), EEF6),
    "dlr_sara_grid_clamp": Spec((take(A),), ((S, (take(S, 0, 6),)),)),
    "dlr_edan_shared_control": Spec((take(A, 0, 6), take(A, -1, None, "invert"))),
    "asu_table_top": Spec((take(A),), (("eef_state", (take("EE"),)), ("gripper_state", (take(S, -1),)))),
    "iamlab_pick_insert": Spec((take(A, 0, 3), take(A, 3, 7, "euler"), take(A, 7, 8)), (("joint_state", (take(S, 0, 7),)), ("gripper_state", (take(S, 7, 8),)))),
    "uiuc_d3field": Spec((take(A), zeros(4))),
    "utaustin_mutex": Spec(INVERTED, ((S, (take(S, 0, 8),)),)),
    "berkeley_fanuc": Spec((take(A), take(S, 6, 7, "invert")), (("joint_state", (take(S, 0, 6),)), ("gripper_state", (take(S, 6, 7),)))),
    "cmu_playing_with_food": Spec((take(A, 0, 3), take(A, 3, 7, "euler"), take(A, -1))),
    "playfusion": Spec((take(A, 0, 3), take(A, -4))),
    "cmu_stretch": Spec((take(A, 0, -1),), (("eef_state", (take(S, 0, 3), zeros(3))), ("gripper_state", (take(S, -1),)))),
    "gnm": Spec((take(A), zeros(5)), ((S, (take("position"), zeros(3), take("yaw"))),)),
    "fmb": Spec((take(A),), (("proprio", (take("eef_pose"), take("state_gripper_pose"))),)),
    "dobbe": Spec((take(A),), (("proprio", (take(S),)),)),
    "roboset": Spec((take(A, 0, 7), take(A, -1, None, "clip_invert")), (("proprio", (take(S),)),)),
    "rh20t": Spec((take("tcp_base"), take("gripper")), (("proprio", (take("tcp_base"), take("gripper_width"))),)),
    "tdroid": Spec((take(A, 0, 6), take(A, -1, None, "binarize")), (("EEF_state", (take("cartesian_position", 0, 6),)), ("gripper_state", (take("gripper_position", -1),)))),
    "libero": Spec(INVERTED, (("EEF_state", (take(S, 0, 6),)), ("gripper_state", (take(S, -2),)))),
    "droid_baseact": Spec((take("translation"), take("rotation"), take("gripper_position", op="invert")), (("proprio", (take("cartesian_position"), take("gripper_position"))),)),
    "droid_finetuning": Spec((take("translation"), take("rotation"), take("gripper_position", op="invert")), (("proprio", (take("cartesian_position"), take("gripper_position"))),)),
}


def sliced(column: Column, start: int | None, stop: int | None) -> Column:
    """A Python slice of an array."""
    n = F.size(column)
    a = F.lit(0) if start is None else (F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0)))
    b = n if stop is None else (F.least(F.lit(stop), n) if stop >= 0 else n + stop)
    return F.slice(column, a + 1, F.greatest(b - a, F.lit(0)))


def found(df: DataFrame, column: str, side: str) -> Column:
    """The column of a side as an array of doubles."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for s in (side, "observation" if side == "action" else "action"):
        if isinstance(types.get(s), T.StructType) and column in types[s].names:
            x, kind = F.col(s)[column], types[s][column].dataType
        elif f"{s}_{column}" in types:
            x, kind = F.col(f"{s}_{column}"), types[f"{s}_{column}"]
        elif s == side and column in types and not isinstance(types[column], T.StructType):
            x, kind = F.col(column), types[column]
        else:
            continue
        return x.cast("array<double>") if isinstance(kind, T.ArrayType) else F.array(x.cast("double"))
    raise ValueError(f"no column {column} for the {side}; there are {', '.join(types)}")


def built(df: DataFrame, part: Part, side: str) -> Column:
    if part.op in ("zeros", "ones"):
        return F.array_repeat(F.lit(0.0 if part.op == "zeros" else 1.0), part.n)
    if part.op in ("binarize", "relative"):
        return F.array(F.col(f"_{part.op}_{part.column}"))
    x = sliced(found(df, part.column, side), part.start, part.stop)
    if part.op == "euler":
        from kinetrail.functions.actions import quaternion_to_euler

        return quaternion_to_euler(x[0], x[1], x[2], x[3])
    if "clip" in part.op:
        x = F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return F.transform(x, lambda v: 1 - v) if "invert" in part.op else x


def standardize(df: DataFrame, spec: Spec | str, by: str = "traj") -> DataFrame:
    """Rows (by, t, source columns) to the same with a standard action and the spec's states. spec may be a registered dataset's name."""
    if isinstance(spec, str):
        spec = SPECS[TRANSFORMS.get(spec, spec)]
    if spec.drop:
        df = stats.drop_first(df)
    for part in spec.action:
        if part.op in ("binarize", "relative"):
            df = df.withColumn("_g", F.element_at(found(df, part.column, "action"), -1))
            df = df.withColumn(f"_{part.op}_{part.column}", windows.binarize_gripper("_g", by) if part.op == "binarize" else windows.relative_to_absolute("_g", by))
    new = {name: F.concat(*(built(df, p, "observation" if i else "action") for p in parts)) for i, (name, parts) in enumerate((("action", spec.action), *spec.state))}
    if spec.relabel:
        new["_relabel"] = found(df, spec.relabel, "observation")
    if spec.language:
        new["language_instruction"] = F.col(spec.language) if spec.language in df.columns else F.col("observation")[spec.language]
    df = df.withColumns(new)
    if spec.relabel:
        df = stats.relabel_from_state(df, "action", "_relabel", 6, by)
    return df.drop(*(c for c in df.columns if c.startswith("_")))
