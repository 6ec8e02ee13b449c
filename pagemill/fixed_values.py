"""Fixed values.

Prompt texts, word lists, markers and constants in this file must equal the
published ones for results to be right, so they are stated plainly here and
nowhere else. Nothing in this file is logic.
"""

# --- fixed prompt texts ---------------------------------------------------

AUTHOR_PROMPT = """[Text]
{web}


[Instruction]
The text above is from an English webpage. According to the text, please infer the author's profile (within 30 words)."""

WI_ALL_PROMPT = """[Text]
{web}


[Author of the Text]
{author}


[Instruction]
The text above is from an English webpage. Imagine that you are a user of an AI assistant, please provide a rewrite {word} specifically designed based on the text content, to create a new version of the text. You can ask for the rewrite to follow constraints including word/sentence/paragraph length, style, format, structure, etc. You should also follow the below rules:
    - The rewrite {word} should strictly follow the profile of the author.
    - The rewrite {word} should be based on the above text, rather than an isolated instruction.
    - The constraints should be detailed and specific.
    - Output only the {word}.
    - Do **not** directly use the keyword 'rewrite' and 'new version' in the generated {word}.
    - Make sure the generated {word} is within {len_limit} words."""

WI_PART_PROMPT = """[Text]
{web}


[Author of the Text]
{author}


[Instruction]
The text above is from an English webpage. Imagine that you are a user of an AI assistant, please provide a rewrite {word} specifically designed based on the text content, to create a new version of the text focusing on a specific part of information, rather than global information, in the given text above. You can ask for the rewrite to follow constraints including word/sentence/paragraph length, style, format, structure, etc. You should also follow the below rules:
    - The rewrite {word} should strictly follow the profile of the author.
    - The rewrite {word} should be based on the above text, rather than an isolated instruction.
    - The constraints should be detailed and specific.
    - Output only the {word}.
    - Do **not** directly use the keyword 'rewrite', 'new version', and 'specific part information' in the generated {word}.
    - Make sure the generated {word} is within {len_limit} words."""

WR_ALL_PROMPT = """[Text]
{web}


[Author of the Text]
{author}


[Instruction]
Imagine that you are a user of an AI assistant, please provide the most likely {word} to which the text above would be a great answer. You should also follow the below rules:
    - The {word} should strictly follow the profile of the author.
    - Ensure your {word} is detailed, specific (including the style, format, and structure of the text), clear, and concise.
    - Output only the {word}.
    - Make sure the generated {word} is within {len_limit} words."""

# The blank line before [Instruction] carries four spaces in this text.
WR_PART_PROMPT = """[Text]
{web}


[Author of the Text]
{author}

    
[Instruction]
Imagine that you are a user of an AI assistant, please provide the most likely {word} to which **a specific part of the text above** would be a great answer. You should also follow the below rules:
    - The {word} should strictly follow the profile of the author.
    - Ensure your {word} is detailed, specific (including the style, format, and structure of the text), clear, and concise.
    - Output only the {word}.
    - Make sure the generated {word} is within {len_limit} words."""

WI_RESPONSE_PROMPT = """{web}


{request}"""

WR_REFINE_PROMPT = """Based on the Provided Information, please improve the Answer to the Question, so that the improved answer is of high quality and factually correct. Only output the improved answer.


[Provided Information]
{web}


[Question]
{request}


[Answer]
{answer}"""

SYSTEM_MESSAGE = "You are a helpful assistant."

LLAMA3_CHAT = (
    "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{prompt}<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n\n"
)

# --- fixed word lists and markers -------------------------------------------

WI_WORDS = ["request", "instruction"]
WR_WORDS = ["request", "question", "instruction"]
LEN_LIMITS = [50, 100, 150, 200]

REQUEST_CATEGORIES = ["WI_all", "WI_part", "WR_all", "WR_part"]
REFINE_CATEGORY = "WR_refine"

STAGE_COLUMNS = {
    "author": ["webpage", "author"],
    "request": ["webpage", "author", "request"],
    "response": ["webpage", "author", "request", "response"],
}

REFUSAL_OPENINGS = ["I'm sorry", "I apologize"]
PREAMBLE_OPENINGS = ["Here is", "Here's"]
IMPROVED_MARKER = "improved answer"

BEGIN_OF_TEXT = "<|begin_of_text|>"
PROMPT_ID_PREFIX = "web_data_"

# --- fixed sizes --------------------------------------------------------------

SAVE_NUM = 100_000
WI_QUOTA = 66_666
WR_QUOTA = 33_333
NUM_PERM = 128
THRESHOLD = 0.7
MAX_ATTEMPTS = 5
RETRY_WAIT_SECONDS = (1, 30)

# --- fixed sampling options of the two model backends ---------------------------

API_OPTIONS = {"temperature": 1.0}
# The model's own end token is added to the stop tokens by the backend that knows it.
BATCH_MODEL_OPTIONS = {"n": 1, "temperature": 0.6, "top_p": 0.9, "max_tokens": 4096, "stop": ["<|eot_id|>"]}
