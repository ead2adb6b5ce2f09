"""What a thread is about: topic, state, the user's role, action items, from its last messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases and patterns must equal the studied definitions. Of topics with equally many phrases the first counts.
TOPICS = {
    "planning": ("let's plan", "when should we", "what day works", "are you free", "want to meet", "let's get together", "should we do", "thinking about", "how about we", "planning to", "want to grab", "let's do", "wanna hang", "wanna go", "want to come", "are you coming", "can you make it", "will you be there", "planning", "schedule"),
    "logistics": ("what time", "where should", "what address", "how do I get", "meet at", "pick you up", "be there by", "running late", "on my way", "almost there", "just left", "eta", "where are you", "directions", "parking", "which entrance", "I'm here", "just arrived", "waiting"),
    "emotional_support": ("I'm sorry", "that's tough", "I understand", "here for you", "feel better", "thinking of you", "so sorry to hear", "hang in there", "I'm here", "let me know if you need", "sending love", "you've got this", "proud of you", "it'll be okay", "don't worry", "feeling down", "bad day", "stressed", "anxious", "worried about", "upset", "sad", "frustrated"),
    "catching_up": ("how are you", "what's new", "long time", "miss you", "how have you been", "what's up", "how's it going", "catch up", "tell me about", "what have you been up to", "how's life", "how was your", "what did you do", "anything new", "how's everything", "good to hear from"),
    "quick_exchange": ("ok", "okay", "sounds good", "got it", "thanks", "thank you", "cool", "great", "perfect", "nice", "lol", "haha", "yes", "no", "yep", "nope", "sure", "np", "kk", "ttyl", "bye"),
    "information": ("do you know", "can you tell me", "what is", "where is", "who is", "how do", "what's the", "I need", "looking for", "have you heard", "did you see", "fyi", "just so you know", "heads up", "reminder", "don't forget", "btw", "wanted to let you know"),
    "decision_making": ("what do you think", "should I", "which one", "your opinion", "help me decide", "can't decide", "what would you", "do you prefer", "better option", "pros and cons", "advice", "recommend", "suggest", "your thoughts", "vote", "choose"),
    "celebration": ("congratulations", "congrats", "so happy for", "amazing news", "great news", "celebrate", "proud of you", "you did it", "well done", "awesome", "exciting", "happy birthday", "cheers", "woohoo", "yay"),
}
ASKS = (r"\?$", r"^(what|where|when|who|why|how|which|can|could|would|will|do|does|did|is|are|was|were)\b", r"\b(let me know|lmk|thoughts\??|wdyt|wyt)\b")
ENDS = (r"\b(sounds good|perfect|great|thanks|bye|later|ttyl|see you|talk soon|cya)\b", r"\b(got it|understood|will do|on it)\b", r"^(ok|okay|k|kk)$")
ACTIONS = (r"(?i)(?:I'll|i'll|I will|i will)\s+(.+?)(?:\.|$)", r"(?i)(?:can you|could you)\s+(.+?)(?:\?|$)", r"(?i)(?:don't forget to|remember to)\s+(.+?)(?:\.|$)", r"(?i)(?:please|pls)\s+(.+?)(?:\.|$)", r"(?i)(?:need to|have to)\s+(.+?)(?:\.|$)")
# End of fixed values.

RECENT, ITEMS = 10, 5


def topic(combined: Column) -> Column:
    """struct(topic, confidence) of lowered text: the topic of most phrases; two or more are surer than one, none is unknown."""
    score = lambda phrases: sum((F.contains(combined, F.lit(p.lower())).cast("int") for p in phrases), F.lit(0))
    scores = F.array(*[F.struct(score(p).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("topic")) for i, (t, p) in enumerate(TOPICS.items())])
    # as an entry of an array the best is worked out once
    best = F.transform(F.array(F.array_max(scores)), lambda b: F.when(b["n"] >= 2, F.struct(b["topic"].alias("topic"), F.round(F.least(F.lit(0.9), 0.5 + b["n"] * 0.1), 6).alias("confidence"))).when(b["n"] >= 1, F.struct(b["topic"].alias("topic"), F.round(0.3 + b["n"] * 0.1, 6).alias("confidence"))).otherwise(F.struct(F.lit("unknown").alias("topic"), F.lit(0.0).alias("confidence"))))
    return F.get(best, F.lit(0))


def state(last: Column, mine: Column) -> Column:
    """Of the last text: a question waits for the other (awaiting_response) or for the user (open_question); closing words conclude; else it goes on."""
    low = F.lower(F.coalesce(last, F.lit("")))
    some = lambda patterns: low.rlike("|".join(f"(?:{p})" for p in patterns))
    return F.when(some(ASKS), F.when(mine, "awaiting_response").otherwise("open_question")).when(some(ENDS), "concluded").otherwise("in_discussion")


def role(first_mine: Column, share: Column) -> Column:
    """initiator for who begins or says over 0.6 of it, responder under 0.3, else participant."""
    return F.when(first_mine | (share > 0.6), "initiator").when(share < 0.3, "responder").otherwise("participant")


def actions(text: Column) -> Column:
    """What a text asks for or promises, of six to 99 characters, in the order of the patterns."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in ACTIONS])
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (F.length(x) > 5) & (F.length(x) < 100))


def thread_contexts(messages: DataFrame, thread: str = "chat_id") -> DataFrame:
    """thread, n, topic, confidence, state, role, items of messages(thread, id, date, is_from_me, text): from the last RECENT of each, the role from all.

    Each thread keeps RECENT messages, however long it is. Items are told once, whatever their case, ITEMS at most. Topics are told by phrases, not by
    an embedding model. Rows with a null thread are one thread.
    """
    last = Window.partitionBy(thread).orderBy(F.desc("date"), F.desc("id"))
    recent = messages.withColumn("r", F.row_number().over(last)).where(F.col("r") <= RECENT)
    one = F.struct("date", "id", "is_from_me", "text", actions(F.col("text")).alias("items"))
    held = recent.groupBy(thread).agg(F.array_sort(F.collect_list(one)).alias("m"))
    texts = F.filter(F.transform("m", lambda x: F.lower(F.coalesce(x["text"], F.lit("")))), lambda x: x != "")
    items = F.flatten(F.transform("m", lambda x: x["items"]))
    end = F.element_at("m", -1)
    held = held.select(thread, topic(F.array_join(texts, " ")).alias("t"), state(end["text"], end["is_from_me"]).alias("state"), items.alias("all"), F.transform(items, lambda x: F.lower(x)).alias("low"))
    once = F.slice(F.filter("all", lambda x, i: F.array_position(F.col("low"), F.lower(x)) == i + 1), 1, ITEMS)
    whole = messages.groupBy(thread).agg(F.count("*").alias("n"), F.min_by("is_from_me", F.struct("date", "id")).alias("first"), (F.count_if("is_from_me") / F.count("*")).alias("share"))
    both = whole.alias("w").join(held.alias("h"), F.col(f"w.{thread}").eqNullSafe(F.col(f"h.{thread}")))
    return both.select(f"w.{thread}", "n", "t.topic", "t.confidence", "state", role(F.col("first"), F.col("share")).alias("role"), once.alias("items"))
