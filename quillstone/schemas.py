"""Schemas of stored tables, as DDL."""

EMBEDDING_METADATA = "struct<version: string, language: string, dimension: int, strategy: string, model: string, created_at: timestamp>"
DOCUMENTS = f"doc_id string, title string, source_type string, source_path string, created_at timestamp, updated_at timestamp, embedding_metadata {EMBEDDING_METADATA}"
CHUNKS = "chunk_id string, doc_id string, content string, chunk_index int, start_offset int, end_offset int, created_at timestamp"
VECTORS = "chunk_id string, doc_id string, q binary, q_min float, q_max float, dim int"
LEGACY_CHUNKS = "id string, documentId string, content string, index int, startOffset int, endOffset int, createdAt timestamp, embedding array<float>"
INPUT = "doc_id string, title string, source_type string, source_path string, text string"
RESULT = "query_id bigint, rank int, score double, chunk_id string, document_id string, source_type string, title string, source_path string, content string, start_offset int, end_offset int"
WINDOW_CHUNK = "chunk_index int, start_offset int, end_offset int, content string, word_count int"
SENTENCE_CHUNK = "chunk_index int, sentences array<string>, content string, sentence_count int, start_sentence int, end_sentence int, context string, estimated_tokens int"
TOKEN_CHUNK = "chunk_index int, content string, estimated_tokens int, start_offset int, end_offset int"
