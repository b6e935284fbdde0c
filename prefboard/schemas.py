"""Explicit schemas of the stored relations."""

MESSAGE = "struct<role:string,content:string>"

PAIR = (
    "id long, position long, language string, split string, subset string, prompt string, "
    "chosen string, rejected string, chosen_model string, rejected_model string"
)
TRANSLATED_PAIR = PAIR + ", target_language string"
REWARD = "id long, chosen double, rejected double"
ANNOTATION = "id long, language string, human_preference string, notes string"
ANSWER_KEY = (
    "id long, language string, subset string, completion_a string, completion_b string, "
    "scores double, swapped int"
)
INSTANCE_RESULT = "model string, language string, position long, result double"

# One schema for every kind of result document; absent fields are null.
DOCUMENT = (
    "dataset string, model string, model_type string, chat_template string, "
    "scores struct<accuracy:double,num_correct:double,num_total:long,results:array<double>>, "
    "leaderboard map<string,double>, subset map<string,string>, "
    "accuracy double, num_prompts long, ref_model string, tokenizer string, "
    "extra_results map<string,string>, subset_results map<string,string>"
)


def leaderboard(languages) -> str:
    """Schema of a wide leaderboard file with one column per language."""
    scores = ", ".join(f"`{language}` double" for language in languages)
    return f"model string, model_type string, family string, avg_multilingual double, {scores}"
