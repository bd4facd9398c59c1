"""Explicit schemas of the record files (DDL)."""

GEN = "question_idx bigint, question string, answer string, prompt string, low_temp_response string, raw_responses array<string>"
JUDGED = "question_idx bigint, question string, prompt string, gold_answer string, low_temp_response string, grade string, semantic_entropy double, raw_responses array<string>, clusters array<array<int>>"
SCAN_RECORD = "question_idx bigint, question string, prompt string, gold_answer string, low_temp_response string, is_correct boolean, semantic_entropy double, cluster_probs map<string,double>, predicted_response string, raw_responses array<string>"
THRESHOLD = "threshold double, teacher_high bigint, student_high bigint, both_high bigint, both_high_pct double, question_indices array<bigint>"
SCAN_FILE = f"metadata map<string,string>, thresholds array<struct<{THRESHOLD.replace(' ', ':').replace(',:', ',')}>>, teacher_records array<struct<{SCAN_RECORD.replace(' ', ':').replace(',:', ',')}>>, student_records array<struct<{SCAN_RECORD.replace(' ', ':').replace(',:', ',')}>>"
CHOICE_SCAN = "question_idx bigint, question string, gold_answer string, teacher_argmax string, prob_on_gold double, choice_entropy double, is_correct boolean"
BIO_GEN = "question_idx bigint, entity string, prompt string, response string"
ABSTENTION = "question_idx bigint, entity string, is_abstained boolean"
TARGET = "question_idx bigint, entity string, teacher_response string"
CLAIM = "question_idx bigint, entity string, claim_idx bigint, claim string, is_true boolean"
ATOMIC_FACT = "question_idx bigint, entity string, sentence_idx bigint, sentence string, facts array<string>"
FACTSCORE = "question_idx bigint, entity string, abstained_or_empty boolean, claims array<struct<atom:string,is_supported:boolean>>"
CLAIM_ENTROPY = CLAIM + ", semantic_entropy double, per_question_entropies array<double>"
SFT_PAIR = "question_idx bigint, prompt string, response string"
PROMPT_AB = "question string, gold string, response_A string, correct_A boolean, response_B string, correct_B boolean, response_C string, correct_C boolean"
SUBSET = "dataset string, n_subset int, seed int, usable_max int, question_indices array<bigint>, note string"
HYPERPARAMETERS = "timestamp string, model_tag string, prompt_style string, run_tag string, job_id string, hyperparameters struct<num_epochs:int,batch_size:int,gradient_accumulation_steps:int,learning_rate:double>"
#: Keys that a generated record must have; an explicit null counts.
REQUIRED = ["question_idx", "question", "answer", "prompt", "low_temp_response", "raw_responses"]
