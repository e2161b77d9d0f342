"""Labels, templates, thresholds and texts that results depend on."""

# Target clause classes.
TARGET_CLAUSES = [
    "Governing Law",
    "Termination For Convenience",
    "Limitation Of Liability",
    "Indemnification",
    "Non-Compete",
    "IP Ownership Assignment",
    "Audit Rights",
    "Change Of Control",
    "Most Favored Nation",
    "Anti-Assignment",
]

# Keyword -> class, first match wins.
CLAUSE_KEYWORDS = [
    ("governing law", "Governing Law"),
    ("termination for convenience", "Termination For Convenience"),
    ("limitation of liability", "Limitation Of Liability"),
    ("indemnification", "Indemnification"),
    ("non-compete", "Non-Compete"),
    ("ip ownership", "IP Ownership Assignment"),
    ("intellectual property", "IP Ownership Assignment"),
    ("audit rights", "Audit Rights"),
    ("change of control", "Change Of Control"),
    ("most favored nation", "Most Favored Nation"),
    ("anti-assignment", "Anti-Assignment"),
    ("assignment", "Anti-Assignment"),
]
OTHER_CLAUSE = "Other"

# Curation.
NO_ANSWER = "No clause found."
MIN_WORDS = 50
MAX_WORDS = 800
CUT_MARKER = " [...]"
DEDUP_THRESHOLD = 0.85
NUM_PERMUTATIONS = 128
PPL_MIN_ROWS = 20
PPL_MIN_WORDS = 10
PPL_FLOOR = 1e-10
PPL_LOW_PERCENT = 5.0
PPL_HIGH_PERCENT = 95.0
TEST_SIZE = 0.15
VAL_SIZE = 0.10
SEED = 42

# Prompt texts.
SYSTEM_PROMPT = (
    "You are a legal contract analysis expert. "
    "Your task is to extract specific clause information from contract text. "
    "Be precise, cite the exact contract language, and indicate if a clause is absent."
)
INSTRUCTION_TEMPLATE = (
    "Analyze the following contract excerpt and extract the '{clause_type}' clause.\n\n"
    "Contract excerpt:\n{contract_text}\n\n"
    "Extract the {clause_type} clause verbatim if present. "
    "If not present, respond with 'No {clause_type} clause found.'"
)

# Chat markers.
BEGIN_TEXT = "<|begin_of_text|>"
ROLE_OPEN = "<|start_header_id|>"
ROLE_CLOSE = "<|end_header_id|>\n\n"
TURN_END = "<|eot_id|>"

# Judge prompts.
JUDGE_TEMPLATE = (
    "You are evaluating a legal clause extraction system.\n\n"
    "Contract excerpt:\n{contract_text}\n\n"
    "Clause type requested: {clause_type}\n\n"
    "Reference answer (ground truth):\n{reference}\n\n"
    "System prediction:\n{prediction}\n\n"
    "Score the prediction on these three dimensions (0-10 each):\n"
    "1. Faithfulness: Does the prediction accurately reflect what is in the contract?\n"
    "2. Completeness: Does it include all important parts of the clause?\n"
    "3. Precision: Is it free from irrelevant or hallucinated content?\n\n"
    "Respond ONLY with a JSON object:\n"
    '{"faithfulness": <0-10>, "completeness": <0-10>, "precision": <0-10>}'
)
PAIR_JUDGE_TEMPLATE = (
    "You are an expert legal-AI evaluator scoring a contract clause-extraction system.\n\n"
    "Contract excerpt:\n{contract_text}\n\n"
    "Clause type requested: {clause_type}\n\n"
    "Output A:\n{output_a}\n\n"
    "Output B:\n{output_b}\n\n"
    "Score EACH output 0-10 on:\n"
    "- faithfulness: does it accurately reflect the contract text? Text that is not "
    "supported by the excerpt (invented parties, unrelated clauses, boilerplate) is a "
    "hallucination and must score LOW.\n"
    "- completeness: does it capture the requested clause? Do NOT reward length — extra "
    "unrelated text does not add completeness.\n"
    "- precision: is it free of irrelevant or hallucinated content? A concise, exact "
    "extraction should score HIGH; an output padded with unrequested or fabricated text "
    "must score LOW.\n\n"
    "A short, exact answer is better than a long one that drifts off the clause. Judge the "
    "two outputs independently and do not assume the longer one is better.\n\n"
    "Respond with ONLY this JSON, no prose:\n"
    '{"A":{"faithfulness":n,"completeness":n,"precision":n},'
    '"B":{"faithfulness":n,"completeness":n,"precision":n}}'
)
JUDGE_DIMENSIONS = ["faithfulness", "completeness", "precision"]
EMPTY_OUTPUT = "(empty)"

# Preference pairs.
STRATEGIES = ["truncate", "hallucinate", "wrong_clause"]
SHORT_REJECTION = "No relevant clause found."
INCOMPLETE_MARKER = "... [incomplete]"
ONE_CLASS_REJECTION = "This clause is not present in the agreement."
FAKE_YEARS = ["2019", "2021", "2022", "2023"]
FAKE_PARTIES = [
    "Apex Technologies Inc.",
    "BlueStar Holdings LLC",
    "Meridian Partners Corp.",
    "Nexus Solutions Ltd.",
]
YEAR_PATTERN = r"\b20\d{2}\b"
PARTY_PATTERN = r"\b[A-Z][a-z]+ (?:Inc\.|LLC|Corp\.|Ltd\.|Co\.)"

# Evaluation.
MODEL_TAGS = ["base", "lora", "qlora", "dpo"]
TUNED_PRIORITY = ["dpo", "qlora", "lora"]
PEAK_MEMORY_GB = {"base": 6.8, "lora": 7.2, "qlora": 3.9, "dpo": 4.1}
EVAL_SAMPLES = 120
JUDGE_SAMPLES = 50
CALIBRATION_SAMPLES = 40
PROMPT_CHARS = 200
ECE_BINS = 10
ACCURATE_F1 = 0.7
PREMISE_WORDS = 512
PAIR_CHARS = 1024
LOWER_IS_BETTER = ["hallucination_rate", "ece"]

# Failure analysis.
FAILURE_F1 = 0.65
MIN_FAILURES = 3
MAP_TEXT_CHARS = 300
NOISE_LABEL = "Noise / Outliers"
PATTERN_TRUNCATED = "Truncated responses"
PATTERN_ABSENT = "False negatives (clause present, not found)"
PATTERN_LONG = "Over-generation / hallucination"
PATTERN_OTHER = "Semantic mismatch"
MAP_WIDTH, MAP_HEIGHT, MAP_MARGIN = 760, 460, 34
