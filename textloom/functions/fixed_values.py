"""Results depend on these exact words, numbers and formats."""

# --- fixed values: English function words ignored when comparing word sets ---
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "can't", "cannot", "com", "could", "couldn't", "did", "didn't", "do",
    "does", "doesn't", "doing", "don't", "down", "during", "each", "else", "ever", "few", "for",
    "from", "further", "had", "hadn't", "has", "hasn't", "have", "haven't", "having", "he", "he'd",
    "he'll", "he's", "her", "here", "here's", "hers", "herself", "him", "himself", "his", "how",
    "how's", "http", "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into", "is", "isn't", "it",
    "it's", "its", "itself", "just", "k", "let's", "like", "me", "more", "most", "mustn't", "my",
    "myself", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "ought", "our",
    "ours", "ourselves", "out", "over", "own", "r", "same", "shall", "shan't", "she", "she'd",
    "she'll", "she's", "should", "shouldn't", "so", "some", "such", "than", "that", "that's", "the",
    "their", "theirs", "them", "themselves", "then", "there", "there's", "these", "they", "they'd",
    "they'll", "they're", "they've", "this", "those", "through", "to", "too", "under", "until",
    "up", "very", "was", "wasn't", "we", "we'd", "we'll", "we're", "we've", "were", "weren't",
    "what", "what's", "when", "when's", "where", "where's", "which", "while", "who", "who's",
    "whom", "why", "why's", "with", "won't", "would", "wouldn't", "www", "you", "you'd", "you'll",
    "you're", "you've", "your", "yours", "yourself", "yourselves",
]

# --- fixed values: words and operators counted by the complexity score ---
LOGIC_WORDS = ["and", "or", "not", "if", "then", "all", "some", "none", "every", "any"]
COMPARISON_OPERATORS = ["<", ">", "<=", ">=", "==", "!="]
MATH_OPERATORS = ["+", "-", "*", "/", "^", "="]

# --- fixed values: phrases counted by the coherence score ---
TRANSITIONS = [
    "therefore", "thus", "hence", "consequently", "as a result", "because",
    "first", "second", "third", "finally", "in conclusion",
    "however", "although", "conversely", "similarly", "likewise", "in addition", "furthermore",
]

# --- fixed values: line openings counted by the structure score ---
CONCLUSION_OPENINGS = ["conclusion:", "answer:", "therefore,", "in summary:"]

# --- fixed values: reasoning types and their default draw weights ---
TASK_TYPES = ["abduction", "deduction", "induction"]
TASK_TYPE_WEIGHTS = [0.3, 0.3, 0.4]

# --- fixed values: prompts (the deduction example names a neutral system) ---
TASK_PROMPT = (
    "You are a problem designer. Generate a novel, challenging reasoning problem "
    "that requires deep thinking."
)
TASK_PROMPT_SUFFIX = {
    "abduction": " The problem must require abductive reasoning, where one infers the most plausible explanation from a set of observations. The answer should not be immediately obvious. Example: 'A detective finds a room with a shattered window, a valuable painting missing, and a single muddy footprint near the window. What is the most likely sequence of events?'",
    "deduction": " The problem must require deductive reasoning, where a conclusion is logically derived from a set of premises. It should involve multiple steps of reasoning. Example: 'All expert systems are intelligent. All intelligent systems use knowledge. Atlas is an expert system. What can you deduce about Atlas?'",
    "induction": " The problem must require inductive reasoning, where a general rule is inferred from specific examples. The pattern should be non-trivial. Example: 'Consider the sequence: 3, 7, 16, 35, 74. What is the next number and what is the rule governing the sequence?'",
}
SOLUTION_PROMPT = (
    "You are a world-class reasoning expert. Solve the following problem by thinking "
    "step-by-step. Provide a clear, structured, and detailed explanation. Enclose your "
    "final answer within <answer> tags."
)
TASK_PREFIXES = ["Task:", "Problem:", "Question:"]
SFT_TEMPLATE = "User: {instruction}\nAssistant: {output}"

# --- fixed values: texts that stand in for a failed generation ---
PLACEHOLDER_SOLUTIONS = {
    "abduction": "To solve this abductive reasoning problem, the most plausible explanation must be inferred from the key observations in '{head}...'. This involves forming and evaluating hypotheses based on the provided evidence.",
    "deduction": "To solve this deductive reasoning problem, logical rules must be strictly applied to the premises given in '{head}...'. The conclusion must necessarily follow if the premises are true.",
    "induction": "To solve this inductive reasoning problem, a general pattern must be identified from the specific instances mentioned in '{head}...'. This pattern can then be used to predict future outcomes or formulate a general rule.",
}
PLACEHOLDER_SOLUTION_DEFAULT = "To solve this problem, I will first break it down into its core components, analyze the relationships between them, and then apply a step-by-step reasoning process to arrive at a logical conclusion."
PLACEHOLDER_TASK = "Create a simple {type} reasoning problem about numbers. For example, if we have a sequence 2, 4, 6, 8, what comes next and why?"
SHORT_TASK = "Create a more detailed and challenging {type} reasoning problem based on the concept of: '{task}'."

# --- fixed values: image normalisation per colour channel (red, green, blue) ---
IMAGE_MEAN = [0.485, 0.456, 0.406]
IMAGE_STD = [0.229, 0.224, 0.225]

# --- fixed values: page elements that carry no content ---
NON_CONTENT_TAGS = ["script", "style", "header", "footer", "nav", "aside"]

# --- fixed values: code points Python's str.split and str.strip treat as blank ---
BLANK_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
BLANK = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
