"""Names of source datasets: how each is standardised, which columns it is loaded from, how far ahead its goals lie, and the named mixtures.

settings() assembles what loading a dataset needs; mixture() lists a mixture's datasets, each once; tables() gives all of it as DataFrames for joins.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The spec in ``standardize.SPECS`` of each registered dataset.
TRANSFORMS: dict[str, str] = dict(
    line.split()
    for line in """
    bridge_oxe bridge_oxe
    bridge_orig bridge_orig
    bridge_dataset bridge_orig
    ppgm ppgm
    ppgm_static ppgm
    ppgm_wrist ppgm
    fractal20220817_data rt1
    kuka kuka
    taco_play taco_play
    jaco_play jaco_play
    berkeley_cable_routing berkeley_cable_routing
    roboturk roboturk
    nyu_door_opening_surprising_effectiveness nyu_door_opening
    viola viola
    berkeley_autolab_ur5 berkeley_autolab_ur5
    toto toto
    language_table language_table
    columbia_cairlab_pusht_real pusht
    stanford_kuka_multimodal_dataset_converted_externally_to_rlds stanford_kuka_multimodal
    nyu_rot_dataset_converted_externally_to_rlds nyu_rot
    stanford_hydra_dataset_converted_externally_to_rlds stanford_hydra
    austin_buds_dataset_converted_externally_to_rlds austin_buds
    nyu_franka_play_dataset_converted_externally_to_rlds nyu_franka_play
    maniskill_dataset_converted_externally_to_rlds maniskill
    furniture_bench_dataset_converted_externally_to_rlds furniture_bench
    cmu_franka_exploration_dataset_converted_externally_to_rlds cmu_franka_exploration
    ucsd_kitchen_dataset_converted_externally_to_rlds ucsd_kitchen
    ucsd_pick_and_place_dataset_converted_externally_to_rlds ucsd_pick_place
    austin_sailor_dataset_converted_externally_to_rlds austin_sailor
    austin_sirius_dataset_converted_externally_to_rlds austin_sirius
    bc_z bc_z
    utokyo_pr2_opening_fridge_converted_externally_to_rlds tokyo_pr2_opening_fridge
    utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds tokyo_pr2_tabletop
    utokyo_xarm_pick_and_place_converted_externally_to_rlds utokyo_xarm_pick_place
    utokyo_xarm_bimanual_converted_externally_to_rlds utokyo_xarm_bimanual
    robo_net robo_net
    berkeley_mvp_converted_externally_to_rlds berkeley_mvp
    berkeley_rpt_converted_externally_to_rlds berkeley_rpt
    kaist_nonprehensile_converted_externally_to_rlds kaist_nonprehensible
    stanford_mask_vit_converted_externally_to_rlds stanford_mask_vit
    tokyo_u_lsmo_converted_externally_to_rlds tokyo_lsmo
    dlr_sara_pour_converted_externally_to_rlds dlr_sara_pour
    dlr_sara_grid_clamp_converted_externally_to_rlds dlr_sara_grid_clamp
    dlr_edan_shared_control_converted_externally_to_rlds dlr_edan_shared_control
    asu_table_top_converted_externally_to_rlds asu_table_top
    stanford_robocook_converted_externally_to_rlds robocook
    imperialcollege_sawyer_wrist_cam imperial_wristcam
    iamlab_cmu_pickup_insert_converted_externally_to_rlds iamlab_pick_insert
    uiuc_d3field uiuc_d3field
    utaustin_mutex utaustin_mutex
    berkeley_fanuc_manipulation berkeley_fanuc
    cmu_playing_with_food cmu_playing_with_food
    cmu_play_fusion playfusion
    cmu_stretch cmu_stretch
    berkeley_gnm_recon gnm
    berkeley_gnm_cory_hall gnm
    berkeley_gnm_sac_son gnm
    droid droid_baseact
    fmb_dataset fmb
    dobbe dobbe
    roboset roboset
    rh20t rh20t
    tdroid_carrot_in_bowl tdroid
    tdroid_pour_corn_in_pot tdroid
    tdroid_flip_pot_upright tdroid
    tdroid_move_object_onto_plate tdroid
    tdroid_knock_object_over tdroid
    tdroid_cover_object_with_towel tdroid
    droid_wipe droid_finetuning
    libero_spatial_no_noops libero
    libero_object_no_noops libero
    libero_goal_no_noops libero
    libero_10_no_noops libero
    """.strip().splitlines()
)

#: Name | primary, secondary and wrist image | the same depths | state columns (- is padding) | state and action encoding.
_CONFIGS = """
fractal20220817_data | image - - | - - - | base_pose_tool_reached gripper_closed | POS_QUAT EEF_POS
kuka | image - - | - - - | clip_function_input/base_pose_tool_reached gripper_closed | POS_QUAT EEF_POS
bridge_oxe | image image_1 - | - - - | EEF_state - gripper_state | POS_EULER EEF_POS
bridge_orig | image_0 image_1 - | - - - | EEF_state - gripper_state | POS_EULER EEF_POS
bridge_dataset | image_0 image_1 - | - - - | EEF_state - gripper_state | POS_EULER EEF_POS
taco_play | rgb_static - rgb_gripper | depth_static - depth_gripper | state_eef - state_gripper | POS_EULER EEF_POS
jaco_play | image - image_wrist | - - - | state_eef - state_gripper | POS_EULER EEF_POS
berkeley_cable_routing | image top_image wrist45_image | - - - | robot_state - | JOINT EEF_POS
roboturk | front_rgb - - | - - - | - - - - - - - - | NONE EEF_POS
nyu_door_opening_surprising_effectiveness | - - image | - - - | - - - - - - - - | NONE EEF_POS
viola | agentview_rgb - eye_in_hand_rgb | - - - | joint_states gripper_states | JOINT EEF_POS
berkeley_autolab_ur5 | image - hand_image | depth - - | state | POS_QUAT EEF_POS
toto | image - - | - - - | state - | JOINT EEF_POS
language_table | rgb - - | - - - | effector_translation - - - - - - | POS_EULER EEF_POS
columbia_cairlab_pusht_real | image - wrist_image | - - - | robot_state - - - - - - | POS_EULER EEF_POS
stanford_kuka_multimodal_dataset_converted_externally_to_rlds | image - - | depth_image - - | ee_position ee_orientation - | POS_QUAT EEF_POS
nyu_rot_dataset_converted_externally_to_rlds | image - - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
stanford_hydra_dataset_converted_externally_to_rlds | image - wrist_image | - - - | eef_state - gripper_state | POS_EULER EEF_POS
austin_buds_dataset_converted_externally_to_rlds | image - wrist_image | - - - | state | JOINT EEF_POS
nyu_franka_play_dataset_converted_externally_to_rlds | image image_additional_view - | depth depth_additional_view - | eef_state - - | POS_EULER EEF_POS
maniskill_dataset_converted_externally_to_rlds | image - wrist_image | depth - wrist_depth | tcp_pose gripper_state | POS_QUAT EEF_POS
furniture_bench_dataset_converted_externally_to_rlds | image - wrist_image | - - - | state | POS_QUAT EEF_POS
cmu_franka_exploration_dataset_converted_externally_to_rlds | highres_image - - | - - - | - - - - - - - - | NONE EEF_POS
ucsd_kitchen_dataset_converted_externally_to_rlds | image - - | - - - | joint_state - | JOINT EEF_POS
ucsd_pick_and_place_dataset_converted_externally_to_rlds | image - - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
austin_sailor_dataset_converted_externally_to_rlds | image - wrist_image | - - - | state | POS_QUAT EEF_POS
austin_sirius_dataset_converted_externally_to_rlds | image - wrist_image | - - - | state | POS_QUAT EEF_POS
bc_z | image - - | - - - | present/xyz present/axis_angle - present/sensed_close | POS_EULER EEF_POS
utokyo_pr2_opening_fridge_converted_externally_to_rlds | image - - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds | image - - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
utokyo_xarm_pick_and_place_converted_externally_to_rlds | image image2 hand_image | - - - | end_effector_pose - - | POS_EULER EEF_POS
utokyo_xarm_bimanual_converted_externally_to_rlds | image - - | - - - | pose_r - - | POS_EULER EEF_POS
robo_net | image image1 - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
berkeley_mvp_converted_externally_to_rlds | - - hand_image | - - - | pose gripper | POS_QUAT JOINT_POS
berkeley_rpt_converted_externally_to_rlds | - - hand_image | - - - | joint_pos gripper | JOINT JOINT_POS
kaist_nonprehensile_converted_externally_to_rlds | image - - | - - - | state - | POS_QUAT EEF_POS
stanford_mask_vit_converted_externally_to_rlds | image - - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
tokyo_u_lsmo_converted_externally_to_rlds | image - - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
dlr_sara_pour_converted_externally_to_rlds | image - - | - - - | state - - | POS_EULER EEF_POS
dlr_sara_grid_clamp_converted_externally_to_rlds | image - - | - - - | state - - | POS_EULER EEF_POS
dlr_edan_shared_control_converted_externally_to_rlds | image - - | - - - | state - | POS_EULER EEF_POS
asu_table_top_converted_externally_to_rlds | image - - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
stanford_robocook_converted_externally_to_rlds | image_1 image_2 - | depth_1 depth_2 - | eef_state - gripper_state | POS_EULER EEF_POS
imperialcollege_sawyer_wrist_cam | image - wrist_image | - - - | - - - - - - - state | NONE EEF_POS
iamlab_cmu_pickup_insert_converted_externally_to_rlds | image - wrist_image | - - - | joint_state gripper_state | JOINT EEF_POS
uiuc_d3field | image_1 image_2 - | depth_1 depth_2 - | - - - - - - - - | NONE EEF_POS
utaustin_mutex | image - wrist_image | - - - | state | JOINT EEF_POS
berkeley_fanuc_manipulation | image - wrist_image | - - - | joint_state - gripper_state | JOINT EEF_POS
cmu_playing_with_food | image - finger_vision_1 | - - - | state - - | POS_EULER EEF_POS
cmu_play_fusion | image - - | - - - | state | JOINT EEF_POS
cmu_stretch | image - - | - - - | eef_state - gripper_state | POS_EULER EEF_POS
berkeley_gnm_recon | - - image | - - - | state - - | POS_EULER EEF_POS
berkeley_gnm_cory_hall | - - image | - - - | state - - | POS_EULER EEF_POS
berkeley_gnm_sac_son | - - image | - - - | state - - | POS_EULER EEF_POS
droid | exterior_image_1_left exterior_image_2_left wrist_image_left | - - - | proprio | POS_QUAT EEF_POS
fmb_dataset | image_side_1 image_side_2 image_wrist_1 | image_side_1_depth image_side_2_depth image_wrist_1_depth | proprio | POS_EULER EEF_POS
dobbe | wrist_image - - | - - - | proprio | POS_EULER EEF_POS
roboset | image_left image_right image_wrist | - - - | proprio | JOINT JOINT_POS
rh20t | image_front image_side_right image_wrist | - - - | proprio | POS_EULER EEF_POS
tdroid_carrot_in_bowl | static_image - - | static_depth_image - - | EEF_state - gripper_state | POS_EULER EEF_POS
tdroid_pour_corn_in_pot | static_image - - | static_depth_image - - | EEF_state - gripper_state | POS_EULER EEF_POS
tdroid_flip_pot_upright | static_image - - | static_depth_image - - | EEF_state - gripper_state | POS_EULER EEF_POS
tdroid_move_object_onto_plate | static_image - - | static_depth_image - - | EEF_state - gripper_state | POS_EULER EEF_POS
tdroid_knock_object_over | static_image - - | static_depth_image - - | EEF_state - gripper_state | POS_EULER EEF_POS
tdroid_cover_object_with_towel | static_image - - | static_depth_image - - | EEF_state - gripper_state | POS_EULER EEF_POS
droid_wipe | exterior_image_2_left - wrist_image_left | - - - | proprio | POS_EULER EEF_POS
libero_spatial_no_noops | image - wrist_image | - - - | EEF_state - gripper_state | POS_EULER EEF_POS
libero_object_no_noops | image - wrist_image | - - - | EEF_state - gripper_state | POS_EULER EEF_POS
libero_goal_no_noops | image - wrist_image | - - - | EEF_state - gripper_state | POS_EULER EEF_POS
libero_10_no_noops | image - wrist_image | - - - | EEF_state - gripper_state | POS_EULER EEF_POS
"""

#: Steps from a step to its goal.
GOALS: dict[str, int] = {
    "fractal20220817_data": 10, "kuka": 30, "bridge": 10, "jaco_play": 30, "berkeley_cable_routing": 20, "roboturk": 4, "viola": 30, "berkeley_autolab_ur5": 10, "toto": 60, "language_table": 6,
    "stanford_hydra_dataset_converted_externally_to_rlds": 24, "austin_buds_dataset_converted_externally_to_rlds": 40, "nyu_franka_play_dataset_converted_externally_to_rlds": 6,
    "furniture_bench_dataset_converted_externally_to_rlds": 20, "ucsd_kitchen_dataset_converted_externally_to_rlds": 4, "austin_sailor_dataset_converted_externally_to_rlds": 40,
    "austin_sirius_dataset_converted_externally_to_rlds": 40, "dlr_edan_shared_control_converted_externally_to_rlds": 10, "iamlab_cmu_pickup_insert_converted_externally_to_rlds": 60, "utaustin_mutex": 44,
    "berkeley_fanuc_manipulation": 30,
}

#: Datasets and sampling weights of the named mixtures.
_MIXTURES = """
bridge: bridge_orig 1.0
bridge_rt_1: bridge_orig 1.0, fractal20220817_data 1.0
rtx: fractal20220817_data 0.54087122203, kuka 0.8341046294, bridge_orig 1.0, jaco_play 2.0, berkeley_cable_routing 3.0, roboturk 1.0, viola 2.0, berkeley_autolab_ur5 1.0, toto 1.0
rtx_franka: fractal20220817_data 0.54087122203, kuka 0.8341046294, bridge_orig 1.0, taco_play 2.0, jaco_play 2.0, berkeley_cable_routing 3.0, roboturk 1.0, viola 2.0, berkeley_autolab_ur5 1.0, toto 1.0, taco_play 1.0, berkeley_cable_routing 1.0, viola 1.0, toto 1.0, stanford_hydra_dataset_converted_externally_to_rlds 1.0, austin_buds_dataset_converted_externally_to_rlds 3.0, nyu_franka_play_dataset_converted_externally_to_rlds 3.0, maniskill_dataset_converted_externally_to_rlds 0.1, furniture_bench_dataset_converted_externally_to_rlds 0.1, cmu_franka_exploration_dataset_converted_externally_to_rlds 5.0, austin_sailor_dataset_converted_externally_to_rlds 1.0, austin_sirius_dataset_converted_externally_to_rlds 1.0, berkeley_rpt_converted_externally_to_rlds 1.0, kaist_nonprehensile_converted_externally_to_rlds 3.0, stanford_robocook_converted_externally_to_rlds 1.0, iamlab_cmu_pickup_insert_converted_externally_to_rlds 1.0, utaustin_mutex 1.0, cmu_play_fusion 1.0
oxe_magic_soup: fractal20220817_data 0.54087122203, kuka 0.8341046294, bridge_orig 1.0, jaco_play 1.0, berkeley_cable_routing 1.0, roboturk 2.0, viola 2.0, berkeley_autolab_ur5 2.0, toto 1.0, language_table 0.1, stanford_hydra_dataset_converted_externally_to_rlds 2.0, austin_buds_dataset_converted_externally_to_rlds 1.0, nyu_franka_play_dataset_converted_externally_to_rlds 3.0, furniture_bench_dataset_converted_externally_to_rlds 0.1, ucsd_kitchen_dataset_converted_externally_to_rlds 2.0, austin_sailor_dataset_converted_externally_to_rlds 1.0, austin_sirius_dataset_converted_externally_to_rlds 1.0, dlr_edan_shared_control_converted_externally_to_rlds 1.0, iamlab_cmu_pickup_insert_converted_externally_to_rlds 1.0, utaustin_mutex 1.0, berkeley_fanuc_manipulation 2.0
oxe_magic_soup_plus: fractal20220817_data 0.54087122203, kuka 0.8341046294, bridge_orig 1.0, taco_play 2.0, jaco_play 1.0, berkeley_cable_routing 1.0, roboturk 2.0, viola 2.0, berkeley_autolab_ur5 2.0, toto 1.0, language_table 0.1, stanford_hydra_dataset_converted_externally_to_rlds 2.0, austin_buds_dataset_converted_externally_to_rlds 1.0, nyu_franka_play_dataset_converted_externally_to_rlds 3.0, furniture_bench_dataset_converted_externally_to_rlds 0.1, ucsd_kitchen_dataset_converted_externally_to_rlds 2.0, austin_sailor_dataset_converted_externally_to_rlds 1.0, austin_sirius_dataset_converted_externally_to_rlds 1.0, dlr_edan_shared_control_converted_externally_to_rlds 1.0, iamlab_cmu_pickup_insert_converted_externally_to_rlds 1.0, utaustin_mutex 1.0, berkeley_fanuc_manipulation 2.0, cmu_stretch 1.0, bc_z 0.2, fmb_dataset 1.0, dobbe 0.2, droid 0.06
oxe_magic_soup_plus_minus: fractal20220817_data 1.0, kuka 0.8341046294, bridge_orig 1.0, taco_play 2.0, jaco_play 1.0, berkeley_cable_routing 1.0, roboturk 2.0, viola 2.0, berkeley_autolab_ur5 2.0, toto 1.0, stanford_hydra_dataset_converted_externally_to_rlds 2.0, austin_buds_dataset_converted_externally_to_rlds 1.0, nyu_franka_play_dataset_converted_externally_to_rlds 3.0, furniture_bench_dataset_converted_externally_to_rlds 0.1, ucsd_kitchen_dataset_converted_externally_to_rlds 2.0, austin_sailor_dataset_converted_externally_to_rlds 1.0, austin_sirius_dataset_converted_externally_to_rlds 1.0, dlr_edan_shared_control_converted_externally_to_rlds 1.0, iamlab_cmu_pickup_insert_converted_externally_to_rlds 1.0, utaustin_mutex 1.0, berkeley_fanuc_manipulation 2.0, cmu_stretch 1.0, bc_z 0.2, fmb_dataset 1.0, dobbe 0.2
"""
#: Mixtures of the one dataset that has their name.
_ALONE = "tdroid_carrot_in_bowl tdroid_pour_corn_in_pot tdroid_flip_pot_upright tdroid_move_object_onto_plate tdroid_knock_object_over tdroid_cover_object_with_towel droid_wipe libero_spatial_no_noops libero_object_no_noops libero_goal_no_noops libero_10_no_noops".split()
VIEWS = ("primary", "secondary", "wrist")
#: Dimensions of an action by its encoding, the last of which, the gripper, is absolute. Other encodings cannot be loaded.
ACTION_SIZE = {"EEF_POS": 7, "EEF_R6": 10}


@dataclass(frozen=True)
class Config:
    name: str
    images: dict[str, str | None]
    depths: dict[str, str | None]
    states: tuple[str | None, ...]
    state_encoding: str
    action_encoding: str


def _config(line: str) -> Config:
    name, images, depths, states, kinds = (x.strip() for x in line.split("|"))
    some = lambda x: [None if c == "-" else c for c in x.split()]
    return Config(name, dict(zip(VIEWS, some(images), strict=True)), dict(zip(VIEWS, some(depths), strict=True)), tuple(some(states)), *kinds.split())


CONFIGS: dict[str, Config] = {c.name: c for c in map(_config, _CONFIGS.strip().splitlines())}
MIXTURES: dict[str, list[tuple[str, float]]] = {
    name: [(d, float(w)) for d, w in (x.split() for x in rest.split(","))] for name, rest in (line.split(":") for line in _MIXTURES.strip().splitlines())
} | {name: [(name, 1.0)] for name in _ALONE}


def masks(encoding: str) -> tuple[list[bool], list[bool]]:
    """Which action dimensions are absolute and which are normalised."""
    if encoding not in ACTION_SIZE:
        raise ValueError(f"actions encoded as {encoding} cannot be loaded; only {', '.join(ACTION_SIZE)}")
    absolute = [False] * (ACTION_SIZE[encoding] - 1) + [True]
    return absolute, [not x for x in absolute]


def settings(name: str, views: tuple[str, ...] = ("primary",), depth: bool = False, proprio: bool = True, language: bool = True) -> dict:
    """What loading a dataset needs: its columns by view, masks and spec. Unknown views and encodings are errors."""
    config = CONFIGS[name]
    absolute, normalised = masks(config.action_encoding)
    if missing := sorted(set(views) - set(VIEWS)):
        raise ValueError(f"{name} has no views {missing}")
    out = {"name": name, "images": {v: c for v, c in config.images.items() if v in views}, "absolute_action_mask": absolute, "action_normalization_mask": normalised, "spec": TRANSFORMS[name]}
    if depth:
        out["depths"] = {v: c for v, c in config.depths.items() if v in views}
    if proprio:
        out["states"] = config.states
    if language:
        out["language"] = "language_instruction"
    if name == "droid":
        out["chunk_filter"] = "zero_action"
    return out


def mixture(name: str, **options) -> list[tuple[dict, float]]:
    """Settings and weight of a mixture's datasets, each once (the first entry counts); those that cannot be loaded are left out with a warning. A name without a mixture is a dataset of weight 1."""
    out: dict[str, tuple[dict, float]] = {}
    for d, weight in MIXTURES.get(name, [(name, 1.0)]):
        if d in out:
            continue
        try:
            out[d] = (settings(d, **options), weight)
        except ValueError as e:
            warnings.warn(f"{d} is left out: {e}", stacklevel=2)
    return list(out.values())


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """datasets (name, spec, view columns, encodings, goal) and mixtures (mixture, pos, name, weight), of fixed size."""
    rows = [(n, TRANSFORMS[n], *(c.images[v] for v in VIEWS), *(c.depths[v] for v in VIEWS), list(c.states), c.state_encoding, c.action_encoding, GOALS.get(n)) for n, c in CONFIGS.items()]
    columns = ", ".join([*(f"image_{v} string" for v in VIEWS), *(f"depth_{v} string" for v in VIEWS)])
    datasets = spark.createDataFrame(rows, f"name string, spec string, {columns}, states array<string>, state_encoding string, action_encoding string, goal int")
    return datasets, spark.createDataFrame([(m, i, d, w) for m, x in MIXTURES.items() for i, (d, w) in enumerate(x)], "mixture string, pos int, name string, weight double")
