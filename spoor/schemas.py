"""Declared schemas; readers never infer."""

CANDIDATE_TOKEN = (
    "token string, token_id int, position int, entropy double, top_k_token_ids array<int>, top_k_probs array<double>, "
    "percentile double, color string"
)
STATISTICS = (
    "total_tokens int, valid_tokens int, avg_entropy double, max_entropy double, min_entropy double, std_entropy double"
)
TRAJECTORY = (
    "id string, original_id string, trajectory_index int, problem string, solution string, prompt string, source string, "
    "task_name string, category string, generated_text string, raw_generated_text string, game_data string, metadata string, "
    "original_data string, tokens array<string>, token_ids array<int>, "
    f"entropy_sequence array<struct<{CANDIDATE_TOKEN.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>, "
    f"statistics struct<{STATISTICS.replace(' int', ':int').replace(' double', ':double')}>, "
    "cutoff_applied boolean, reward double, termination_reason string"
)
# Heavy text and the candidate arrays left out: what entropy analysis reads.
TRAJECTORY_SLIM = (
    "id string, original_id string, trajectory_index int, solution string, source string, "
    "entropy_sequence array<struct<token:string,token_id:int,position:int,entropy:double>>, reward double, termination_reason string"
)
EVALUATION = (
    "id string, is_correct boolean, extracted_answer string, ground_truth string, original_id string, comparison_method string, "
    "reward double, termination_reason string, status string"
)
CONFIDENCE_LIST = "model_input string, generator string, question_id string, output array<string>, confidence_list array<double>"
AGENT_RESULTS = (
    "info struct<num_trials:int,environment_info:struct<domain_name:string>,agent_info:struct<llm:string>,user_info:struct<llm:string>>, "
    "tasks array<struct<id:string,evaluation_criteria:struct<actions:array<struct<action_id:string,requestor:string,name:string,"
    "arguments:map<string,string>,compare_args:array<string>>>,communicate_info:array<string>,env_assertions:array<string>,"
    "nl_assertions:array<string>,reward_basis:array<string>>>>, "
    "simulations array<struct<id:string,task_id:string,trial:int,seed:int,reward_info:struct<reward:double,reward_basis:array<string>,"
    "reward_breakdown:map<string,double>>,agent_cost:double,user_cost:double,termination_reason:string,duration:double,"
    "messages array<struct<role:string,content:string,turn_idx:int>>>>".replace("messages array", "messages:array")
)
