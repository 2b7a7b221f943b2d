"""Explicit schemas of the audit's data; read with these, never by inference."""

GRADED = "struct<found:boolean,reward:double,f2p_pass:int,f2p_fail:int,p2p_pass:int,p2p_fail:int,f2p_failing:array<string>,p2p_failing:array<string>>"
ANALYSIS = "struct<symbol:string,failing:array<string>,coupled:array<string>,broke:array<string>,unparsed:array<string>,all_reference_the_symbol:boolean,unparsed_log_shape:boolean>"
ROW = (
    "struct<operator:string,tier:string,file:string,anchor:string,verdict:string,reason:string,observable:string,loud_failure:boolean,detail:string,"
    f"graded_log:string,graded_report:{GRADED},failure_analysis:{ANALYSIS},tree_digest:string,witness_side:string>"
)
RECORD = (
    "instance_id string, image string, repo string, version string, targets array<string>, n_targets int, multi_target boolean, mountable boolean,"
    f" control struct<passed:boolean,reason:string,graded:{GRADED},log:string>,"
    " row struct<index:int,name:string,mode:string,valid:boolean,reason:string,elapsed:double,error:string,error_type:string>,"
    f" rows array<{ROW}>, log array<array<string>>, operators_with_anchors array<string>, operators_not_applicable array<string>, witnesses array<{ROW}>,"
    " on_prime_hub string, on_prime_hub_reason string, elapsed_seconds double, error string, completed boolean, disk_residual_bytes bigint,"
    " disk_orphan_reclaimed_bytes bigint, digest_trace array<struct<digest:string,memo_hit:boolean>>, leaked_image boolean, leaked_containers array<string>"
)
ELIGIBLE = (
    "instance_id string, repo string, base_commit string, n_files int, files_touched array<string>, targets array<string>, n_targets int,"
    " single_file boolean, eligible boolean, n_fail_to_pass int, n_pass_to_pass int"
)
EVENT = "t double, event string, instance_id string, seconds double, error string, reason string, sleep_s double, consecutive int"
CALL = "instance_id string, temperature double, call int, score int, parse_error string, input_tokens bigint, output_tokens bigint, output_cap_hit boolean, elapsed double"

# fixed values
VERDICTS = ("WITNESS", "CLEAN", "INVALID", "UNVALIDATED", "REFUSED", "NOT_APPLICABLE")
JUDGED = ("WITNESS", "CLEAN", "INVALID")
WITNESS_SIDES = ("p2p_coupling", "f2p_only", "p2p_unattributed", "unknown")
