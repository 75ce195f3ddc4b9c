"""Declared schemas: a column that a file lacks is NULL, and none is ever inferred."""

FACT = "struct<entity_id:string,entity_name:string,attribute:string,attribute_display:string,unit:string,value:double,is_target:boolean,form:string,parts:array<struct<label:string,value:double>>,part_index:int,corrupted:boolean,true_value:double,formatted:string>"
PLAN = f"document_id string, world_id string, theme_id string, condition string, role string, genre string, observer_role string, requested_word_count int, narrative_seed bigint, style map<string,string>, entity_ids array<string>, target_facts array<{FACT}>, distractor_facts array<{FACT}>, categorical_facts array<struct<entity_id:string,entity_name:string,attribute:string,value:string>>, leak_statement string, pool_index int"
DOCUMENT = PLAN + ", text string, provenance string, generator_backend string, generator_model string, generator_revision string, decoding map<string,string>, attempts int, actual_word_count int, validation struct<ok:boolean,problems:array<string>,actual_word_count:int>, prompt_hash string, generated_at string"
RECORD = "experiment_id string, theme string, theme_synthetic boolean, world_id string, world_name string, distribution string, seed int, arm string, corpus_id string, condition string, provenance string, density double, num_documents int, baseline string, question_id string, family string, statistic string, attribute string, template_index int, entity_id string, target_world_id string, prompt string, model_output string, predicted_value double, extraction_method string, true_value double, absolute_error double, relative_error double, target_truth double, model_checkpoint string, decoding map<string,string>, visible_stated_value double, visible_true_value double, evaluated_at string"
QUESTION = "world_id string, question_id string, family string, statistic string, attribute string, prompt string, true_value double, target_world_id string, entity_id string, template_index int, notes map<string,double>"
TRAINING = "id string, text string"
