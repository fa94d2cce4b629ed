"""The vocabularies of the video domain."""

from __future__ import annotations

# Detector classes by id.
CLASSES = ["pedestrian", "people", "bicycle", "car", "van", "truck", "bus"]
HUMAN = ["pedestrian", "people"]
VEHICLE = ["car", "van", "truck", "bus"]
BICYCLE = ["bicycle"]
#: Relationships count bicycles among the vehicles; searches motorcycles as well.
VEHICLE_PAIRS = ["car", "van", "truck", "bus", "bicycle"]
VEHICLE_SEARCH = ["car", "bus", "van", "truck", "bicycle", "motorcycle"]

# Words of a search query.
CLASS_ALIASES = {
    "person": "pedestrian", "persons": "pedestrian", "people": "pedestrian", "pedestrian": "pedestrian", "pedestrians": "pedestrian",
    "car": "car", "cars": "car", "bus": "bus", "buses": "bus", "van": "van", "vans": "van", "truck": "truck", "trucks": "truck",
    "bicycle": "bicycle", "bicycles": "bicycle", "bike": "bicycle", "bikes": "bicycle",
    "motorcycle": "motorcycle", "motorcycles": "motorcycle", "motorbike": "motorcycle", "motorbikes": "motorcycle",
}
GROUP_WORDS = ["vehicle", "vehicles"]
COLORS = ["black", "white", "gray", "grey", "blue", "red", "green", "yellow", "orange", "pink", "purple", "brown"]
DIRECTIONS = [
    "top_left_to_bottom_right", "top_right_to_bottom_left", "bottom_left_to_top_right", "bottom_right_to_top_left",
    "left_to_right", "right_to_left", "top_to_bottom", "bottom_to_top",
]
COLUMNS, ROWS = ["left", "center", "right"], ["top", "middle", "bottom"]
#: Either order of the words names a region.
EXACT_REGIONS = {f"{h}_{v}": [f"{h} {v} region", f"{v} {h} region"] for v in ROWS for h in COLUMNS}
BROAD_REGIONS = {
    "left": ["left side", "left region", "on the left"],
    "right": ["right side", "right region", "on the right"],
    "center": ["center side", "centre side", "central region", "in the center", "in the centre"],
    "top": ["top side", "top region", "at the top"],
    "bottom": ["bottom side", "bottom region", "at the bottom"],
}
MOVING_WORDS = ["moving", "moved", "walking", "walked", "traveling", "travelling", "going"]
STATIONARY_PHRASES = ["stationary", "standing", "stopped", "still", "not moving", "remained stationary"]
RELATIONSHIPS = {"near": ["near", "nearby", "close to"], "overlapping": ["overlap", "overlapping", "overlapped"], "together": ["together"]}

# Words that tell the intent of a query.
RELATIONSHIP_TERMS = [
    "near", "nearby", "close to", "close together", "next to", "beside", "together", "overlap", "overlapping", "intersect", "relationship",
    "interacting", "interaction", "with each other",
]
OBJECT_TERMS = [
    "car", "cars", "bus", "buses", "van", "vans", "truck", "trucks", "bicycle", "bicycles", "bike", "bikes", "motorcycle", "motorcycles",
    "pedestrian", "pedestrians", "person", "people", "vehicle", "vehicles",
]

# The wider vocabulary of the stand-alone constraint parser.
CONSTRAINT_CLASSES = {
    "pedestrian": ["pedestrian", "pedestrians", "person", "persons", "people", "man", "men", "woman", "women", "human", "humans"],
    "car": ["car", "cars", "automobile", "automobiles"],
    "bus": ["bus", "buses"],
    "van": ["van", "vans"],
    "truck": ["truck", "trucks", "lorry", "lorries"],
    "bicycle": ["bicycle", "bicycles", "bike", "bikes", "cycle", "cycles", "cyclist", "cyclists"],
    "motorcycle": ["motorcycle", "motorcycles", "motorbike", "motorbikes"],
}
CONSTRAINT_COLORS = ["black", "white", "gray", "grey", "red", "blue", "green", "yellow", "orange", "brown", "purple", "pink"]
CONSTRAINT_MOTION = {
    "stationary": ["stationary", "standing still", "not moving", "stopped", "parked"],
    "moving": ["moving", "moved", "travelling", "traveling"],
    "slow_moving": ["slow moving", "slowly moving", "moving slowly"],
}
CONSTRAINT_DIRECTIONS = [
    "left_to_right", "right_to_left", "top_to_bottom", "bottom_to_top",
    "top_left_to_bottom_right", "top_right_to_bottom_left", "bottom_left_to_top_right", "bottom_right_to_top_left",
]
CONSTRAINT_REGIONS = {
    "left_top": ["left top", "top left region", "top left side"],
    "center_top": ["center top", "top center", "top middle"],
    "right_top": ["right top", "top right region", "top right side"],
    "left_middle": ["left middle", "middle left"],
    "center_middle": ["center middle", "middle center", "center of the frame", "centre of the frame"],
    "right_middle": ["right middle", "middle right"],
    "left_bottom": ["left bottom", "bottom left region", "bottom left side"],
    "center_bottom": ["center bottom", "bottom center", "bottom middle"],
    "right_bottom": ["right bottom", "bottom right region", "bottom right side"],
}
CONSTRAINT_BROAD = {
    "left": ["left side", "left region", "on the left"],
    "center": ["center region", "centre region", "in the center", "in the centre"],
    "right": ["right side", "right region", "on the right"],
    "top": ["top region", "at the top"],
    "bottom": ["bottom region", "at the bottom"],
}

# The hybrid parser's words, in order of precedence.
HYBRID_OBJECTS = ["person", "car", "truck", "bus", "bicycle", "motorcycle", "bike", "helmet", "backpack", "bag", "dog", "cat"]
HYBRID_COLORS = ["red", "blue", "green", "yellow", "black", "white", "gray", "grey", "brown", "orange", "pink", "purple"]
HYBRID_ACTIONS = ["walking", "running", "standing", "sitting", "riding", "driving", "carrying", "entering", "leaving", "crossing"]
HYBRID_ATTRIBUTES = ["helmet", "backpack", "bag", "cap", "hat", "glasses", "mask"]

# The shared grammar's words.
OBJECT_ALIASES = {
    "person": "person", "people": "person", "man": "person", "men": "person", "woman": "person", "women": "person",
    "vehicle": "vehicle", "vehicles": "vehicle", "car": "car", "cars": "car", "truck": "truck", "trucks": "truck", "bus": "bus", "buses": "bus",
    "motorcycle": "motorcycle", "motorcycles": "motorcycle", "bike": "bicycle", "bikes": "bicycle", "bicycle": "bicycle", "bicycles": "bicycle",
    "backpack": "backpack", "backpacks": "backpack", "helmet": "helmet", "helmets": "helmet", "bag": "bag", "bags": "bag",
    "chair": "chair", "chairs": "chair", "dog": "dog", "dogs": "dog",
}
GRAMMAR_COLORS = ["red", "blue", "green", "yellow", "white", "black", "gray", "grey", "orange", "pink", "purple", "brown"]
GRAMMAR_ACTIONS = ["walking", "running", "standing", "sitting", "carrying", "riding", "driving", "entering", "leaving"]
GRAMMAR_ATTRIBUTES = ["shirt", "helmet", "backpack", "bag", "umbrella", "cap", "hat", "mask", "glasses"]
GRAMMAR_ZONES = ["entrance", "exit", "gate", "parking", "road", "building", "corridor", "sidewalk"]
WEARABLE = ["helmet", "backpack", "bag"]

# Synonyms and stop values of semantic metadata.
COLOR_SYNONYMS = {
    "dark blue": "blue", "light blue": "blue", "navy": "blue", "royal blue": "blue", "sky blue": "blue",
    "dark red": "red", "light red": "red", "maroon": "red", "dark green": "green", "light green": "green", "olive": "green",
    "grey": "gray", "dark grey": "gray", "light grey": "gray", "silver": "gray", "cream": "white", "ivory": "white",
}
ATTRIBUTE_SYNONYMS = {
    "bag": "backpack", "school bag": "backpack", "travel bag": "backpack", "rucksack": "backpack", "cap": "hat", "helmet cap": "helmet",
    "spectacles": "glasses", "sunglasses": "glasses",
}
IGNORED_ATTRIBUTES = ["", "unknown", "text", "none", "null", "n/a"]
IGNORED_ACTIONS = ["", "unknown", "none"]
IGNORED_COLORS = ["", "unknown"]
VOICE_ENGLISH = ["person", "car", "blue", "shirt"]
