"""headwater.llm"""
