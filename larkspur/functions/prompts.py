"""Prompts, as expressions over a turn's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of the prompts; fixed values.
SYSTEM_ONLINE = "you are a query rewriter and knowledge selector"
SYSTEM_BATCH = "You are a query rewriter and knowledge selector."
SYSTEM_SELECT = "You are a good information selector"
SELECT_INTRO = "For an information-seeking dialog, please select the user information that will help answer this question (if there is any).\n"
SELECT_END = "(Now you need to give me a list of the serial numbers you have chosen. The output format should always be: Provenance: $The user information number you have selected."
P1_START = (
    "### Instruction: I will give you a conversation between a user and a system. "
    "Also will give you some background information about the user. "
    "You should answer the last utterance of the user based on user background information. "
    "Please remember that your answer to the last question the user shouldn't be more than 200 words.\n"
    "### Background information about the user: \n"
)
P1_END = (
    "\n### Response: \n"
    "### Can you generate the unique queries that can be used for retrieving your previous answer to the user? "
    "(Please write queries in one line and don't generate more than 5 queries)\n"
    "### Queries: \n(Now, you should give me the Response and the Queries. "
    "The output format should always be: Response: $Response Queries: $Queries. Go ahead!)"
)
REWRITE_INTRO = (
    "For an information-seeking dialog, please help reformulate the question "
    "into a rewrite that can fully express the user's information needs without the need for context, "
    "but also generate an informative response to answer the question. "
)
P2_USE = "You can generate a rewrite and response based on the user's personal information(if any).\n#YourTask: \n User's personal information:\n"
SAR_USE = "You can generate a rewrite and response based on the user's personal information."
AUTOMATIC_INTRO = (
    "For an information-seeking dialog, please help reformulate the question "
    "into rewrite that can fully express the user's information needs without the need of context, "
    "but also generate an informative response to answer the question. "
    "You can generate a rewrite and response based on user's personal information. "
)
ANSWER = (
    "(Now, you should give me the rewrite and an informative response of the **Current Question** based on the **Context**. "
    "Please provide a complete informative response, but keep it under 200 words. "
    "The output format should always be: "
)
ANSWER_REWRITE = ANSWER + "Rewrite: $Rewrite\nResponse: $Response. Go ahead!)"
ANSWER_SAR = ANSWER + "Provenance: $The user information number you are using\nRewrite: $Rewrite\nResponse: $Response. Go ahead!)"
EXAMPLES = "I will provide you with some examples:\n"
TASK_SELECT = "#Your Task (only user's information, questions and the responses are given):\n\nUser's information: "
TASK_SAR = "#Your Task (only user's information, questions and the response are given):\n\nUser's information: "
TASK_AUTOMATIC = "#Your Task:\n\nUser's personal information: "


def text_repr(text: Column) -> Column:
    """A text as it prints inside a dict: single quotes, or double ones if it holds an apostrophe and no double quote."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def facts_repr(facts: Column) -> Column:
    """An array of (idx, fact) as a dict prints."""
    return F.concat(F.lit("{"), F.array_join(F.transform(facts, lambda f: F.concat(text_repr(f["idx"]), F.lit(": "), text_repr(f["fact"]))), ", "), F.lit("}"))


def history(questions: Column, answers: Column) -> Column:
    """Earlier questions and answers, as far as both go."""
    n = F.least(F.size(questions), F.size(answers))
    pairs = F.arrays_zip(F.slice(questions, F.lit(1), n).alias("q"), F.slice(answers, F.lit(1), n).alias("a"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("Question: "), p["q"], F.lit("\nResponse: "), p["a"], F.lit("\n\n"))), "")


def label(facts: Column) -> Column:
    """The chosen facts' texts, each with a line end; 'None' if there are none."""
    joined = F.array_join(F.transform(facts, lambda f: F.concat(f, F.lit("\n"))), "")
    return F.when(F.regexp_replace(joined, r"(?U)\s+", "") == "", F.lit("None")).otherwise(joined)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _examples(demo: str | Column | None, lead: str, gap: str) -> list[Column | str]:
    return [lead + EXAMPLES + gap, demo, "\n\n"] if demo is not None else []


def select(facts: Column, past: Column, question: Column, demo: str | Column | None = None, batch: bool = False) -> Column:
    return _text(SELECT_INTRO, *_examples(demo, "", "" if batch else " "), TASK_SELECT, facts_repr(facts), "\n\n", past, "Question: ", question, "\n\n", SELECT_END + ")" * batch)


def reformulate(kind: int, label_: Column, past: Column, question: Column) -> Column:
    if kind == 1:
        return _text(P1_START, label_, "\n ### Conversation: \n", past, "Current Question: ", question, P1_END)
    if kind == 2:
        return _text(REWRITE_INTRO + P2_USE, label_, "\n", past, "Current Question: ", question, "\n" + ANSWER_REWRITE)
    raise ValueError(f"prompt type {kind}")


def select_and_reformulate(facts: Column, past: Column, question: Column, demo: str | Column | None = None) -> Column:
    return _text(REWRITE_INTRO + SAR_USE, *_examples(demo, " ", " "), TASK_SAR, facts_repr(facts), "\n\n", past, "Question: ", question, "\n\n", ANSWER_SAR)


def automatic(fact: Column, past: Column, question: Column) -> Column:
    return _text(AUTOMATIC_INTRO + TASK_AUTOMATIC, fact, "\n\n", past, "Current Question: ", question, "\n\n", ANSWER_REWRITE)
