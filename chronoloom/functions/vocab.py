"""Closed vocabularies."""

# Speakers that are told apart in subtitles.
SPEAKERS = ("denji", "reze", "makima", "aki", "power", "pochita")
# Emotions and kinds of scene of a tag.
EMOTIONS = ("tender", "happy", "tense", "action", "fear", "grief", "neutral")
SCENES = ("dialogue", "action", "establishing", "reaction")
# Sound cues that count as impacts.
IMPACT_CUES = (
    "explosion", "explosions", "blast", "blasts", "gunshot", "gunshots", "gunfire", "screams", "scream", "screaming", "shouts", "shout", "shouting",
    "crash", "crashing", "roars", "roar", "roaring", "grunts", "groans", "explosion stops", "gasps", "yells", "yelling", "rumbling", "explosions continue",
)
