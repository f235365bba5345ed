"""headwater.streaming"""
