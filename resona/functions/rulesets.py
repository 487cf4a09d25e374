"""Rule patterns, word lists, headings, bins and defaults.

Rule order matters (the first match wins where one label is asked for). Patterns are written in
Python ``re`` syntax; ``resona.functions.rules`` turns them into the JVM's.
"""

from __future__ import annotations

# --- counters of a post, in order -------------------------------------------------------------
COUNT_COLUMNS = ("play_count", "digg_count", "comment_count", "share_count", "collect_count")

# --- candidate names of a post id, in order ---------------------------------------------------
POST_ID_NAMES = ("video_id", "post_id", "aweme_id", "id")

# --- fixed values: themes of a summary --------------------------------------------------------
THEME_RULES = {
    "climate_impacts": r"\b(flood|fire|wildfire|drought|heatwave|storm|disaster|melting|sea level|extreme weather|climate crisis)\b",
    "solutions_action": r"\b(solution|action|reduce|reuse|recycle|renewable|solar|wind|plant|vote|policy|petition|protest|activism)\b",
    "accountability_policy": r"\b(government|policy|corporate|company|fossil fuel|oil|gas|emissions|carbon|greenwash|accountability)\b",
    "education_awareness": r"\b(explain|learn|science|fact|evidence|awareness|educat|inform|myth|understand)\b",
    "nature_biodiversity": r"\b(nature|animal|wildlife|ocean|forest|tree|reef|species|biodiversity|planet)\b",
    "lifestyle_consumer": r"\b(food|vegan|diet|fashion|thrift|plastic|waste|travel|consumer|lifestyle|home)\b",
}
THEME_DEFAULT = "uncategorized"

# --- fixed values: mood of a summary ----------------------------------------------------------
MOOD_RULES = {
    "urgent_alarm": r"\b(urgent|alarming|grave|fear|anxious|dire|warning|crisis|catastrophic)\b",
    "hopeful_empowering": r"\b(hope|optimistic|empower|inspiring|solution|positive|encouraging)\b",
    "humorous_ironic": r"\b(humor|funny|satirical|sarcastic|ironic|playful|meme)\b",
    "angry_critical": r"\b(angry|frustrated|critical|outrage|blame|condemn)\b",
    "reflective_somber": r"\b(somber|serious|reflective|sad|melancholy|concerned)\b",
}
MOOD_DEFAULT = "neutral_or_mixed"

# --- fixed values: call to action of a summary ------------------------------------------------
ACTION_RULES = {
    "individual_action": r"\b(you can|individual|personal|at home|lifestyle|recycle|diet|shop|reduce|reuse)\b",
    "collective_action": r"\b(we can|community|together|collective|movement|join|protest|campaign)\b",
    "policy_systemic": r"\b(policy|government|systemic|corporate|regulation|vote|petition|fossil fuel|accountability)\b",
    "awareness_only": r"\b(awareness|inform|educat|explain|shows|highlights|depicts)\b",
}
ACTION_DEFAULT = "no_clear_action"

# --- fixed values: intent of a comment --------------------------------------------------------
INTENT_RULES = {
    "action_oriented": r"\b(i can|i will|i'll|start|try|plant|garden|bike|bus|recycle|eco|meat|vegan|vegetarian|do this|make it work|help out)\b",
    "barrier_or_constraint": r"\b(hard|can't|cannot|don't know|parents|school|expensive|afford|where|how|but|problem)\b",
    "skeptic_or_counter": r"\b(fake|not real|scam|hoax|china|india|doesn't matter|too late|hypocrite)\b",
    "info_question": r"\?",
    "support_affect": r"\b(love|beautiful|amazing|true|yes|thank|save|needs us|sad|cry|wow)\b",
}
INTENT_DEFAULT = "general_reaction"

# --- fixed values: emotion of a comment -------------------------------------------------------
EMOTION_RULES = {
    "hope": r"\b(hope|solution|can do|help|save|progress|better|work)\b",
    "anxiety": r"\b(scared|fear|worried|anxious|too late|hard|crisis|disaster|die|kill)\b",
    "confusion": r"\b(how|what|why|where|don't know|dont know|can i|would|should)\b|\?",
    "anger": r"\b(angry|hate|blame|hypocrite|stupid|wrong|greedy|scam|hoax)\b",
    "support": r"\b(love|thank|yes|true|beautiful|amazing|agree|same)\b",
}
EMOTION_DEFAULT = "neutral"

# --- fixed values: sentiment words and threshold ----------------------------------------------
POSITIVE_WORDS = (
    "action", "amazing", "beautiful", "better", "care", "cool", "encourage", "good", "great",
    "help", "hope", "love", "progress", "save", "solution", "thank", "true", "yes",
)
NEGATIVE_WORDS = (
    "angry", "bad", "crisis", "die", "disaster", "fear", "hard", "hate", "hoax", "kill", "late",
    "pollution", "problem", "sad", "scam", "terrible", "threat", "wrong",
)
SENTIMENT_THRESHOLD = 0.15

# --- fixed values: headings of a summary text, one captured section each ----------------------
SECTION_PATTERNS = {
    "overall_mood_tone": r"\*\*.*?overall mood.*?\*\*\n?(.*?)(?=\n\*\*|$)",
    "overall_narrative_message": r"\*\*.*?narrative.*?\*\*\n?(.*?)(?=\n\*\*|$)",
    "prominent_objects_actions": r"\*\*.*?(?:key events|prominent objects).*?\*\*\n?(.*?)(?=\n\*\*|$)",
    "description_storyline": r"\*\*.*?(?:describe the video|storyline).*?\*\*\n?(.*?)(?=\n\*\*|$)",
    "music_description": r"\*\*.*?(?:music track|audio used).*?\*\*\n?(.*?)(?=\n\*\*|$)",
    "audio_nature": r"\*\*.*?(?:nature of the audio).*?:\*\*\s*(.*?)(?=\n\*\*|$)",
    "prominent_audio_content": r"\*\*.*?(?:prominent sounds|spoken content|audio content|prominent lines).*?:\*\*\n?(.*?)(?=\n\*\*|$)",
}

# --- fixed values: size classes of a creator, upper bound of followers (inclusive) -------------
CREATOR_SCALE = (("nano", 1_000), ("micro", 10_000), ("mid", 100_000), ("macro", 1_000_000), ("mega", None))

# --- fixed values: weights of the two blended scores ------------------------------------------
OPPORTUNITY_WEIGHTS = {"eng_rank_pct": 0.40, "views_rank_pct": 0.35, "share_rank_pct": 0.25}
BRIDGE_WEIGHTS = {"betweenness": 0.45, "degree": 0.25, "engagement": 0.20, "followers": 0.10}

# --- fixed values: text columns that make up the text to cluster, in order ---------------------
CLUSTER_TEXT_COLUMNS = (
    "semantic_text", "text_for_nlp", "overall_narrative_message", "summary_text", "title",
)

MISSING_SUMMARY = "missing_summary"
