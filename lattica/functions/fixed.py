"""Fixed values that results depend on: word lists, palettes, prompts and limits. They state facts, in natural order."""

from __future__ import annotations

# Words that are never keywords of a note.
KEYWORD_STOPWORDS = """
a about above after again against all am an and any are arent as at be because been before being below between both but by
cant cannot could couldnt did didnt do does doesnt doing dont down during each few for from further get got had hadnt has
hasnt have havent having he hed hell hes her here heres hers herself him himself his how hows i id ill im ive if in into is
isnt it its itself lets me more most mustnt my myself no nor not of off on once only or other ought our ours ourselves out
over own same shant she shed shell shes should shouldnt so some such than that thats the their theirs them themselves then
there theres these they theyd theyll theyre theyve this those through to too under until up very was wasnt we wed well were
weve werent what whats when whens where wheres which while who whos whom why whys will with wont would wouldnt you youd
youll youre youve your yours yourself yourselves also just like can may use used using make made new one two three first
second last many much now way time say
""".split()

# Words that are never sub-keywords in a graph.
GRAPH_STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can
cannot could did do does doing down during each few for from further get got had has have having he her here hers herself
him himself his how if in into is it its itself just like me more most my myself no nor not of off on once only or other our
ours out over own same she should so some such than that the their them themselves then there these they this those through
to too under until up use used using very was we were what when where which while who whom why will with would you your
yours also make made new one two three first second last many much now way time say
""".split()

# Colours of topics (by top keyword) and of notes in the global graph (by position); the first eight agree.
GRAPH_COLOURS = ["#6366f1", "#f59e0b", "#10b981", "#ef4444", "#3b82f6", "#8b5cf6", "#f97316", "#14b8a6", "#e879f9", "#84cc16", "#fb7185", "#38bdf8"]
TOPIC_COLOURS = ["#6366f1", "#f59e0b", "#10b981", "#ef4444", "#3b82f6", "#8b5cf6", "#f97316", "#14b8a6"]

# Limits.
KEYWORDS_PER_NOTE = 10
LINKS_PER_NOTE = 8
LEAST_STRENGTH = 0.15
SUB_KEYWORDS = 5
RESULTS = 20
RECENT = 10
VERSIONS_KEPT = 20
UPLOAD_BYTES = 5 * 1024 * 1024
UPLOAD_CHARS = 10_000
TITLE_CHARS = 200

# What a language model is asked for each study feature.
PROMPTS = {
    "summarize": "Summarize the following notes in 4-5 clear sentences highlighting the main ideas. Write in plain prose, no bullet points.",
    "flashcards": "Generate 6 flashcard Q&A pairs from these notes. Return ONLY a valid JSON array — no markdown, no code fences, no explanation, nothing else. Format exactly: [{\"q\":\"question\",\"a\":\"answer\"}]",
    "concepts": "Extract 8 key concepts from these notes. Return ONLY a valid JSON array — no markdown, no code fences, no explanation, nothing else. Format exactly: [{\"term\":\"term\",\"definition\":\"one sentence definition\"}]",
    "examQs": "Generate 5 exam-style questions with detailed answers from these notes. Return ONLY a valid JSON array — no markdown, no code fences, no explanation, nothing else. Format exactly: [{\"question\":\"q\",\"answer\":\"a\"}]",
    "eli5": "Explain the following notes as if explaining to a 12-year-old. Use simple words, short sentences, and fun analogies. No jargon.",
}
