"""Fixed tables: prompt templates, system texts, chat roles, evaluation hierarchies.

Everything in this file is a fixed value that has to equal the published one for results to match.
Two templates that are published under a vendor's product name are called ``eoh_eoa_chat`` and
``im_chat`` here, after their markup.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """How one exchange is written.

    ``instruction`` frames the question, ``system`` stands before it where the exchange brings a system text,
    ``suffix`` closes the answer (and takes the place of EOS if ``suffix_as_eos``), ``sep`` parts exchanges.
    """

    instruction: str
    system: str | None = None
    suffix: str = ""
    suffix_as_eos: bool = False
    sep: str = ""
    stop_words: tuple[str, ...] = ()


# Prompt templates.
TEMPLATES: dict[str, Template] = {
    "default": Template(
        system="<|System|>:{system}\n", instruction="<|User|>:{input}\n<|Bot|>:", sep="\n"),
    "zephyr": Template(
        system="<|system|>\n{system}\n", instruction="<|user|>\n{input}\n<|assistant|>\n", sep="\n"),
    "eoh_eoa_chat": Template(
        system="<|System|>:{system}\n", instruction="<|User|>:{input}<eoh>\n<|Bot|>:",
        suffix="<eoa>", suffix_as_eos=True, sep="\n", stop_words=("<eoa>",)),
    "im_chat": Template(
        system="<|im_start|>system\n{system}<|im_end|>\n",
        instruction="<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n",
        suffix="<|im_end|>", suffix_as_eos=True, sep="\n", stop_words=("<|im_end|>",)),
    "moss_sft": Template(
        system="{system}\n", instruction="<|Human|>: {input}<eoh>\n", sep="\n",
        stop_words=("<eoc>", "<eom>")),
    "llama2_chat": Template(
        system="[INST] <<SYS>>\n You are a helpful, respectful and honest assistant. Always answer as "
               "helpfully as possible, while being safe. Your answers should not include any harmful, "
               "unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your "
               "responses are socially unbiased and positive in nature.\n{system}\n<</SYS>>\n [/INST] ",
        instruction="[INST] {input} [/INST]", sep="\n"),
    "code_llama_chat": Template(system="{system}\n", instruction="[INST] {input} [/INST]"),
    "chatglm2": Template(
        system="{system}\n", instruction="[Round {round}]\n\n问：{input}\n\n答：", sep="\n\n"),
    "chatglm3": Template(
        system="<|system|>\n{system}", instruction="<|user|>\n{input}<|assistant|>\n", sep="\n"),
    "qwen_chat": Template(
        system="<|im_start|>system\n{system}<|im_end|>\n",
        instruction="<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n",
        suffix="<|im_end|>", suffix_as_eos=True, sep="\n", stop_words=("<|im_end|>", "<|endoftext|>")),
    "baichuan_chat": Template(
        system="{system}\n", instruction="<reserved_102>{input}<reserved_103>", sep="\n"),
    "baichuan2_chat": Template(
        system="{system}\n", instruction="<reserved_106>{input}<reserved_107>", sep="\n"),
    "wizardlm": Template(
        system="A chat between a curious user and an artificial intelligence assistant. The assistant "
               "gives helpful, detailed, and polite answers to the user's questions. {system}\n ",
        instruction="USER: {input} ASSISTANT:", sep="\n"),
    "wizardcoder": Template(
        system="Below is an instruction that describes a task. Write a response that appropriately "
               "completes the request.\n\n{system}\n ",
        instruction="### Instruction:\n{input}\n\n### Response:", sep="\n\n"),
    "vicuna": Template(
        system="A chat between a curious user and an artificial intelligence assistant. The assistant "
               "gives helpful, detailed, and polite answers to the user's questions. {system}\n ",
        instruction="USER: {input} ASSISTANT:", sep="\n"),
    "deepseek_coder": Template(
        system="You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by "
               "DeepSeekCompany, and you only answer questions related to computer science. For "
               "politically sensitive questions, security and privacy issues, and other non-computer "
               "science questions, you will refuse to answer. {system}\n",
        instruction="### Instruction:\n{input}\n### Response:\n", sep="\n"),
    "deepseekcoder": Template(
        system="You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by "
               "DeepSeekCompany, and you only answer questions related to computer science. For "
               "politically sensitive questions, security and privacy issues, and other non-computer "
               "science questions, you will refuse to answer. {system}\n",
        instruction="### Instruction:\n{input}\n### Response:\n", sep="\n"),
    "deepseek_moe": Template(
        system="[INST] {system} [/INST]\n", instruction="[INST] {input} [/INST]", sep="\n"),
    "deepseek_v2": Template(
        system="{system}\n\n", instruction="User: {input}\n\nAssistant: ",
        suffix="<｜end▁of▁sentence｜>", suffix_as_eos=True, stop_words=("<｜end▁of▁sentence｜>",)),
    "deepseek_qwen": Template(
        system="{system}\n\n", instruction="<｜User｜>{input}<｜Assistant｜>",
        suffix="<｜end▁of▁sentence｜>", suffix_as_eos=True, sep="\n",
        stop_words=("<｜end▁of▁sentence｜>",)),
    "mistral": Template(
        system="[INST] {system} [/INST]\n", instruction="[INST] {input} [/INST]", sep="\n"),
    "mixtral": Template(
        system="[INST] {system} [/INST]\n", instruction="[INST] {input} [/INST]", sep="\n"),
    "minicpm": Template(instruction="<用户> {input} <AI>", sep="\n"),
    "minicpm3": Template(
        system="<|im_start|>system\n{system}<|im_end|>\n",
        instruction="<|im_start|>user\n{input}<|im_end|>\n<|im_start|>assistant\n",
        suffix="<|im_end|>", suffix_as_eos=True, sep="\n", stop_words=("<|im_end|>", "<|endoftext|>")),
    "gemma": Template(
        system="<start_of_turn>system\n{system}<end_of_turn>\n",
        instruction="<start_of_turn>user\n{input}<end_of_turn>\n<start_of_turn>model\n",
        suffix="<end_of_turn>", suffix_as_eos=False, sep="\n", stop_words=("<end_of_turn>",)),
    "cohere_chat": Template(
        system="<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{system}<|END_OF_TURN_TOKEN|>",
        instruction="<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{input}<|END_OF_TURN_TOKEN|>"
                    "<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>",
        suffix="<|END_OF_TURN_TOKEN|>", suffix_as_eos=True, stop_words=("<|END_OF_TURN_TOKEN|>",)),
    "llama3_chat": Template(
        system="<|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|>",
        instruction="<|start_header_id|>user<|end_header_id|>\n\n{input}<|eot_id|>"
                    "<|start_header_id|>assistant<|end_header_id|>\n\n",
        suffix="<|eot_id|>", suffix_as_eos=True, stop_words=("<|eot_id|>",)),
    "phi3_chat": Template(
        system="<|system|>\n{system}<|end|>\n", instruction="<|user|>\n{input}<|end|>\n<|assistant|>\n",
        suffix="<|end|>", suffix_as_eos=True, sep="\n", stop_words=("<|end|>",)),
}

# System texts.
SYSTEMS: dict[str, str] = {
    "moss_sft": "You are an AI assistant whose name is {bot_name}.\n"
                "Capabilities and tools that {bot_name} can possess.\n"
                "- Inner thoughts: enabled.\n"
                "- Web search: enabled. API: Search(query)\n"
                "- Calculator: enabled. API: Calculate(expression)\n"
                "- Equation solver: enabled. API: Solve(equation)\n"
                "- Text-to-image: disabled.\n"
                "- Image edition: disabled.\n"
                "- Text-to-speech: disabled.\n",
    "alpaca": "Below is an instruction that describes a task. Write a response that appropriately "
              "completes the request.\n",
    "arxiv_gentile": "If you are an expert in writing papers, please generate a good paper title for this "
                     "paper based on other authors' descriptions of their abstracts.\n",
    "colorist": "You are a professional color designer. Please provide the corresponding colors based on "
                "the description of Human.\n",
    "coder": "You are a professional programer. Please provide the corresponding code based on the "
             "description of Human.\n",
    "lawyer": "你现在是一名专业的中国律师，请根据用户的问题给出准确、有理有据的回复。\n",
    "medical": "如果你是一名医生，请根据患者的描述回答医学问题。\n",
    "sql": "If you are an expert in SQL, please generate a good SQL Query for Question based on the "
           "CREATE TABLE statement.\n",
}


@dataclass(frozen=True)
class ChatTemplate:
    """Message-wise template: one pattern per role, ``sep`` behind each assistant message."""

    system: str
    user: str
    assistant: str
    sep: str = "\n"
    stop_words: tuple[str, ...] = ()


# Message-wise chat templates.
CHAT_TEMPLATES: dict[str, ChatTemplate] = {
    "im_chat": ChatTemplate(
        system="<|im_start|>system\n{system}<|im_end|>\n",
        user="<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n",
        assistant="{assistant}<|im_end|>", stop_words=("<|im_end|>",)),
    "qwen2": ChatTemplate(
        system="<|im_start|>system\n{system}<|im_end|>\n",
        user="<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n",
        assistant="{assistant}<|im_end|>", stop_words=("<|im_end|>", "<|endoftext|>")),
    "llama3": ChatTemplate(
        system="<|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|>",
        user="<|start_header_id|>user<|end_header_id|>\n\n{user}<|eot_id|>"
             "<|start_header_id|>assistant<|end_header_id|>\n\n",
        assistant="{assistant}<|eot_id|>", sep="", stop_words=("<|eot_id|>",)),
}


@dataclass(frozen=True)
class Role:
    """Begin and end marks of a chat role, and where its content carries loss."""

    plain: str = ""
    named: str = ""
    end: str = ""
    loss_types: tuple[str, ...] = ()
    end_loss: bool = False
    belong: str | None = None


# Roles of the chat markup, tool-name tokens and special tokens.
CHAT_ROLES: dict[str, Role] = {
    "system": Role("<|im_start|>system\n", "<|im_start|>system name={name}\n", "<|im_end|>\n"),
    "user": Role("<|im_start|>user\n", "<|im_start|>user name={name}\n", "<|im_end|>\n"),
    "assistant": Role("<|im_start|>assistant\n", "<|im_start|>assistant name={name}\n", "<|im_end|>\n",
                      loss_types=("icl", "current"), end_loss=True),
    "environment": Role("<|im_start|>environment\n", "<|im_start|>environment name={name}\n", "<|im_end|>\n"),
    "tool": Role("", "<|action_start|>{name}\n", "<|action_end|>\n", belong="assistant"),
    "thought": Role("", "", "", belong="assistant"),
}
NAME_TOKENS = {"interpreter": "<|interpreter|>", "plugin": "<|plugin|>"}
# Roles whose names map to tokens; a user name stays as written.
NAME_TOKEN_ROLES = ("system", "assistant", "environment", "tool")
SPECIAL_TOKENS = ("<|plugin|>", "<|interpreter|>", "<|action_end|>", "<|action_start|>", "<|im_end|>",
                  "<|im_start|>")

# Subject -> subcategory and subcategory -> category of the 57-subject exam.
SUBJECTS: dict[str, str] = {
    "abstract_algebra": "math",
    "anatomy": "health",
    "astronomy": "physics",
    "business_ethics": "business",
    "clinical_knowledge": "health",
    "college_biology": "biology",
    "college_chemistry": "chemistry",
    "college_computer_science": "computer science",
    "college_mathematics": "math",
    "college_medicine": "health",
    "college_physics": "physics",
    "computer_security": "computer science",
    "conceptual_physics": "physics",
    "econometrics": "economics",
    "electrical_engineering": "engineering",
    "elementary_mathematics": "math",
    "formal_logic": "philosophy",
    "global_facts": "other",
    "high_school_biology": "biology",
    "high_school_chemistry": "chemistry",
    "high_school_computer_science": "computer science",
    "high_school_european_history": "history",
    "high_school_geography": "geography",
    "high_school_government_and_politics": "politics",
    "high_school_macroeconomics": "economics",
    "high_school_mathematics": "math",
    "high_school_microeconomics": "economics",
    "high_school_physics": "physics",
    "high_school_psychology": "psychology",
    "high_school_statistics": "math",
    "high_school_us_history": "history",
    "high_school_world_history": "history",
    "human_aging": "health",
    "human_sexuality": "culture",
    "international_law": "law",
    "jurisprudence": "law",
    "logical_fallacies": "philosophy",
    "machine_learning": "computer science",
    "management": "business",
    "marketing": "business",
    "medical_genetics": "health",
    "miscellaneous": "other",
    "moral_disputes": "philosophy",
    "moral_scenarios": "philosophy",
    "nutrition": "health",
    "philosophy": "philosophy",
    "prehistory": "history",
    "professional_accounting": "other",
    "professional_law": "law",
    "professional_medicine": "health",
    "professional_psychology": "psychology",
    "public_relations": "politics",
    "security_studies": "politics",
    "sociology": "culture",
    "us_foreign_policy": "politics",
    "virology": "health",
    "world_religions": "philosophy",
}
CATEGORIES: dict[str, tuple[str, ...]] = {
    "STEM": ("physics", "chemistry", "biology", "computer science", "math", "engineering"),
    "humanities": ("history", "philosophy", "law"),
    "social sciences": ("politics", "culture", "economics", "geography", "psychology"),
    "other (business, health, misc.)": ("other", "business", "health"),
}

# Short names of abilities in the circular evaluation.
ABILITY_NAMES = {
    "coarse_perception": "CP",
    "finegrained_perception (instance-level)": "FP-S",
    "finegrained_perception (cross-instance)": "FP-C",
    "logic_reasoning": "LR",
    "relation_reasoning": "RR",
    "attribute_reasoning": "AR",
    "sketch_reasoning": "Sketch Reasoning",
    "scenery_building": "Scenery & Building",
    "food_clothes": "Food & Clothes",
    "historical_figure": "Historical Figure",
    "traditional_show": "Traditional Show",
    "calligraphy_painting": "Calligraphy Painting",
    "cultural_relic": "Cultural Relic",
}

# Region instruction patterns (locate, locate in evaluation, identify).
REFER_PATTERNS = (
    "[refer] {}",
    "[refer] give me the location of {}",
    "[refer] where is {} ?",
    "[refer] from this image, tell me the location of {}",
    "[refer] the location of {} is",
    "[refer] could you tell me the location for {} ?",
    "[refer] where can I locate the {} ?",
)
REFER_EVAL_PATTERNS = ("[refer] give me the location of {}",)
IDENTIFY_PATTERNS = (
    "[identify] {}",
    "[identify] what object is in this location {}",
    "[identify] identify the object present at this location {}",
    "[identify] what is it in {}",
    "[identify] describe this object in {}",
    "[identify] this {} is",
    "[identify] the object in {} is",
)

# Closing lines of a multiple-choice prompt.
MCQ_CLOSING_CJK = "请直接回答选项字母。"
MCQ_CLOSING = "Answer with the option's letter from the given choices directly."
