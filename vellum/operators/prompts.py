"""The system prompt: fixed policies, rules and the glossary, the same for every page of a run."""

from __future__ import annotations

REGISTER = {
    "conversational": "Sound like a friendly present-day speaker; choose everyday words over learned or official ones.",
    "literary": "Sound like a careful literary author; rarer words are welcome where they read well.",
    "academic": "Sound like a scholar; one term for one notion, throughout.",
}
PROPER_NOUNS = {
    "keep_latin": "Names of people, places, firms and products stay in Latin letters, letter for letter.",
    "devanagari": "Names are spelt out in Devanagari letters.",
    "devanagari_first_use": "Names are spelt out in Devanagari letters; where a chapter first has one, its Latin spelling follows in brackets.",
}
IDIOMS = {
    "keep_english": "Set phrases stay in English within the translated sentence.",
    "translate_meaning": "Say what a set phrase means; money, places and customs stay those of the source.",
    "english_plus_gloss": "Set phrases stay in English; where one first comes, its meaning follows in brackets.",
}
RULES = (
    "Translate every block; never summarise, merge, drop or reorder blocks.",
    "Keep every number, date, percentage, amount and unit as written.",
    "Keep the setting; this is a translation, not a localisation.",
    "Keep <i> and <b> around the corresponding words; use no other markup.",
    "Agree gender and number in every sentence.",
    "Keep the meaning of each paragraph; add nothing.",
    "Stay near the length of the source.",
)


def system_prompt(register: str, proper_nouns: str, idioms: str, glossary: str) -> str:
    rules = "\n".join(f"{k}. {r}" for k, r in enumerate(RULES, 1))
    return f"You translate an English book into Marathi.\n\n{REGISTER[register]}\n{PROPER_NOUNS[proper_nouns]}\n{IDIOMS[idioms]}\n\nRules:\n{rules}\n\nGlossary, to be used exactly:\n{glossary}\n"
