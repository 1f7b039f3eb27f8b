"""The fixed outer schemas: tables are rows, their variable part sits in arrays."""
CORPUS_SCHEMA = (
    "database_name string, table_name string, columns array<string>, "
    "column_datatypes array<string>, rows array<array<string>>, "
    "foreign_keys array<struct<column:string,property_id:string,reference_table:string>>, "
    "filepath string, num_rows_total bigint"
)
VECTOR_SCHEMA = (
    "point_id string, dataset string, model string, db_name string, table_name string, "
    "schema array<string>, num_rows bigint, source_collection string, embedding array<float>"
)
RUN_METRICS_SCHEMA = (
    "dataset string, model string, collection string, model_path string, "
    "encoding_inference_time_seconds double, indexing_time_seconds double, "
    "index_size_bytes bigint, index_size_mb double, embeddings_count bigint, "
    "processed_tables bigint, skipped_tables bigint, embedding_dimension int, "
    "embeddings_size_bytes bigint, embeddings_size_mb double, timestamp_start string, "
    "timestamp_end string, total_time_seconds double, throughput_embeddings_per_sec double, "
    "avg_time_per_embedding_ms double, storage_per_1k_embeddings_mb double, "
    "gpu_available boolean, device string"
)
EPOCH_SCHEMA = (
    "run string, epoch int, train_loss double, val_loss double, learning_rate double, "
    "best_val_loss double, pearson double, spearman double, early_stopped boolean, "
    "elapsed_seconds double, timestamp string"
)
