"""Lookup tables whose contents decide the results.

Everything here is data, in the order in which it is commonly listed.
"""

# Subset, category, weight in the category average. `math-prm` is
# weighted 983 so that it counts as much as all code subsets together.
SUBSETS = [
    ("alpacaeval-easy", "Chat", 79),
    ("alpacaeval-length", "Chat", 79),
    ("alpacaeval-hard", "Chat", 76),
    ("mt-bench-easy", "Chat", 24),
    ("mt-bench-med", "Chat", 38),
    ("mt-bench-hard", "Chat Hard", 35),
    ("llmbar-natural", "Chat Hard", 76),
    ("llmbar-adver-neighbor", "Chat Hard", 124),
    ("llmbar-adver-GPTInst", "Chat Hard", 87),
    ("llmbar-adver-GPTOut", "Chat Hard", 42),
    ("llmbar-adver-manual", "Chat Hard", 43),
    ("refusals-dangerous", "Safety", 100),
    ("refusals-offensive", "Safety", 100),
    ("xstest-should-refuse", "Safety", 154),
    ("xstest-should-respond", "Safety", 247),
    ("donotanswer", "Safety", 135),
    ("math-prm", "Reasoning", 983),
    ("hep-cpp", "Reasoning", 164),
    ("hep-go", "Reasoning", 164),
    ("hep-java", "Reasoning", 164),
    ("hep-js", "Reasoning", 164),
    ("hep-python", "Reasoning", 163),
    ("hep-rust", "Reasoning", 164),
]

CATEGORIES = ["Chat", "Chat Hard", "Safety", "Reasoning"]

# Fixed value: prefix of the code subsets.
CODE_PREFIX = "hep-"

# Display names of subsets.
SUBSET_TITLES = {
    "alpacaeval-easy": "AlpacaEval Easy",
    "alpacaeval-length": "AlpacaEval Length",
    "alpacaeval-hard": "AlpacaEval Hard",
    "mt-bench-easy": "MT Bench Easy",
    "mt-bench-med": "MT Bench Medium",
    "mt-bench-hard": "MT Bench Hard",
    "llmbar-natural": "LLMBar Natural",
    "llmbar-adver-neighbor": "LLMBar Adver. Neighbor",
    "llmbar-adver-GPTInst": "LLMBar Adver. GPTInst",
    "llmbar-adver-GPTOut": "LLMBar Adver. GPTOut",
    "llmbar-adver-manual": "LLMBar Adver. Manual",
    "refusals-dangerous": "Refusals Dangerous",
    "refusals-offensive": "Refusals Offensive",
    "xstest-should-refuse": "XSTest Should Refuse",
    "xstest-should-respond": "XSTest Should Respond",
    "donotanswer": "Do Not Answer",
    "math-prm": "PRM Math",
    "hep-cpp": "HumanEvalPack CPP",
    "hep-go": "HumanEvalPack Go",
    "hep-java": "HumanEvalPack Java",
    "hep-js": "HumanEvalPack Javascript",
    "hep-python": "HumanEvalPack Python",
    "hep-rust": "HumanEvalPack Rust",
    "anthropic_harmless": "Anthropic Harmless",
    "anthropic_helpful": "Anthropic Helpful",
    "anthropic_hhh": "Anthropic HHH",
    "mtbench_gpt4": "MT Bench GPT-4",
    "mtbench_human": "MT Bench Human",
    "shp": "SHP",
    "summarize": "Summarize",
}

# FLORES-200 code -> language name.
ENGLISH = "eng_Latn"
LANGUAGE_NAMES = {
    "eng_Latn": "English",
    "arb_Arab": "Arabic",
    "zho_Hans": "Chinese_Simplified",
    "zho_Hant": "Chinese_Traditional",
    "ces_Latn": "Czech",
    "nld_Latn": "Dutch",
    "fra_Latn": "French",
    "deu_Latn": "German",
    "ell_Grek": "Greek",
    "heb_Hebr": "Hebrew",
    "hin_Deva": "Hindi",
    "ind_Latn": "Indonesian",
    "ita_Latn": "Italian",
    "jpn_Jpan": "Japanese",
    "kor_Hang": "Korean",
    "pes_Arab": "Persian",
    "pol_Latn": "Polish",
    "por_Latn": "Portuguese",
    "ron_Latn": "Romanian",
    "rus_Cyrl": "Russian",
    "spa_Latn": "Spanish",
    "tur_Latn": "Turkish",
    "ukr_Cyrl": "Ukrainian",
    "vie_Latn": "Vietnamese",
}

# Three-letter language -> short label (jp, kr and fa as published).
LANGUAGE_LABELS = {
    "arb": "ar",
    "ces": "cs",
    "deu": "de",
    "ell": "el",
    "fra": "fr",
    "heb": "he",
    "hin": "hi",
    "ind": "id",
    "ita": "it",
    "jpn": "jp",
    "kor": "kr",
    "nld": "nl",
    "pes": "fa",
    "pol": "pl",
    "por": "pt",
    "ron": "ro",
    "rus": "ru",
    "spa": "es",
    "tur": "tr",
    "ukr": "uk",
    "vie": "vi",
    "zho": "zh",
}

# Model id -> display name.
MODEL_TITLES = {
    "openai/gpt-4-turbo-2024-04-09": "GPT-4 Turbo",
    "openai/gpt-4o-2024-05-13": "GPT-4o",
    "google/gemma-2-9b-it": "Gemma 2 9B",
    "LxzGordon/URM-LLaMa-3.1-8B": "URM LlaMa 3.1 8B",
    "meta-llama/Meta-Llama-3.1-70B-Instruct": "Llama 3.1 70B",
    "meta-llama/Meta-Llama-3-70B-Instruct": "Llama 3 70B",
    "CIR-AMS/BTRM_Qwen2_7b_0613": "BTRM Qwen 2 7B",
    "cohere/command-r-plus-08-2024": "Command R+",
    "allenai/tulu-2-dpo-13b": "Tulu 2 13B DPO",
    "cohere/c4ai-aya-23-35b": "Aya 23 35B",
}

# Labels of model types in reports.
MODEL_TYPE_LABELS = {
    "DPO": "Implicit RM",
    "Sequence Classifier": "Classifier RM",
}

# Provider prefix -> model names served by that provider.
PROVIDER_MODELS = {
    "openai": [
        "gpt-3.5-turbo",
        "gpt-3.5-turbo-0301",
        "gpt-3.5-turbo-0613",
        "gpt-3.5-turbo-1106",
        "gpt-3.5-turbo-0125",
        "gpt-4",
        "gpt-4-0314",
        "gpt-4-0613",
        "gpt-4-turbo",
        "gpt-4-1106-preview",
        "gpt-4-0125-preview",
        "gpt-4-turbo-2024-04-09",
        "gpt-4o-2024-05-13",
    ],
    "anthropic": [
        "claude-1",
        "claude-2",
        "claude-2.0",
        "claude-2.1",
        "claude-instant-1",
        "claude-instant-1.2",
        "claude-3-opus-20240229",
        "claude-3-sonnet-20240229",
        "claude-3-haiku-20240307",
        "claude-3-5-sonnet-20240620",
    ],
    "google": [
        "gemini-1.5-flash-001",
        "gemini-1.5-pro-001",
    ],
    "cohere": [
        "command-r-plus",
        "command-r",
        "command",
        "command-nightly",
        "command-light",
        "command-light-nightly",
        "c4ai-aya-23-35b",
        "c4ai-aya-23-8b",
    ],
}

# Substring of the model name -> prompt family; first hit wins.
PROMPT_FAMILIES = [
    ("prometheus", "prometheus"),
    ("gemini", "gemini"),
    ("Llama-3.1", "llama-3.1"),
    ("gemma", "gemma"),
    ("glm-4", "glm-4"),
    ("Qwen2", "qwen-2"),
]

# Fixed value: number of prompts stated in imported English classifier results.
IMPORTED_NUM_PROMPTS = 2985

# Metadata keys inside a generative document's subset map.
SUBSET_METADATA_KEYS = ["model", "model_type", "chat_template"]
