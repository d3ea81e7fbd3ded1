"""Row schemas."""

from __future__ import annotations

#: One wide row for human and machine samples; what a kind lacks is null.
SAMPLE = "code string, label string, year string, day string, language string, model string, prompt string, code_variant string, style_variant string, use_comp_programming boolean, repo string, author string, path string"
REPOSITORY = "name string, full_name string, ssh_url string, clone_url string, language string, description string, topics array<string>"
BATCH_REQUEST = "custom_id string, method string, url string, body struct<model:string,input:array<struct<role:string,content:string>>,max_output_tokens:int>"
BATCH_RESPONSE = "custom_id string, response struct<body:struct<output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>>"
_SUMMARY = "struct<name:string,group_mode:string,accuracy_mean:double,accuracy_std:double,f1_mean:double,f1_std:double,confusion_matrix_sum:array<array<bigint>>>"
ABLATION_LOG = f"group_mode string, n_splits int, ablation_runs array<struct<ablation:string,name:string,tfidf_set:string,accuracy:double,f1_macro:double,confusion_matrix:array<array<bigint>>,folds:array<struct<fold:int,accuracy:double,f1_macro:double,confusion_matrix:array<array<bigint>>>>,summary:{_SUMMARY}>>"
