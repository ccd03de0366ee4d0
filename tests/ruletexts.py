"""Texts beside the rules of the table."""

#: A text for each rule, and one beside it that must not fire it.
RULE_TEXTS = {
    "wdr.subject.application_withdrawn": ("application withdrawn", "application received"), "wdr.body.you_withdrew": ("you've withdrew", "they withdrew"), "wdr.body.application_withdrawn": ("application was withdrawn", "application was sent"), "wdr.body.at_your_request": ("at your request", "at his request"),
    "rej.subject.not_moving_forward": ("not be moving forward", "moving forward"), "rej.subject.unsuccessful": ("unsuccessful", "successful"), "rej.subject.position_filled": ("role has been filled", "role has been opened"), "rej.body.not_moving_forward": ("not proceed with your file", "proceed with your file"),
    "rej.body.decided_not_to": ("decided not to pursue", "decided to pursue"), "rej.body.other_candidates": ("another candidate", "a candidate"), "rej.body.pursue_other_candidates": ("pursuing other applicants", "pursuing applicants"), "rej.body.unfortunately": ("unfortunately you were not chosen", "unfortunately we cannot answer all. we do not mind"),
    "rej.body.not_selected": ("were not shortlisted", "were shortlisted"), "rej.body.no_longer_under_consideration": ("no longer being considered", "being considered"), "rej.body.not_a_match": ("not the right fit", "the right fit"), "rej.body.position_filled": ("opening is now closed", "opening is now open"), "rej.body.keep_resume_on_file": ("keep your cv on file", "keep your cat on file"), "rej.body.wish_you_the_best": ("wish you all the very best", "wish you were here"),
    "off.subject.offer": ("your offer", "our offer"), "off.body.pleased_to_offer": ("thrilled to formally extend", "pleased to meet"), "off.body.extend_an_offer": ("extending you an offer", "extending the lease"), "off.body.offer_letter": ("compensation package", "package"), "off.body.start_date": ("tentative start date", "start date"),
    "itv.subject.interview_invitation": ("invitation to an interview", "invitation to a party"), "itv.subject.schedule_interview": ("schedule your phone screen", "schedule your flight"), "itv.subject.phone_screen": ("recruiter screen", "touch screen"), "itv.subject.onsite": ("final round", "round"), "itv.subject.next_steps": ("next steps", "steps"), "itv.body.invite_to_interview": ("invite you for a chat", "invite you home"), "itv.body.select_a_time": ("choose some time", "choose sides"),
    "itv.body.schedule_link": ("use the link below to book", "use the link. then to book"), "itv.body.availability": ("share your availability", "share your joy"), "itv.body.interview_scheduled": ("interview is confirmed", "interview was long"), "itv.body.speak_with": ("meet with our engineers", "meet with friends"),
    "asm.subject.online_assessment": ("technical test", "taste test"), "asm.subject.take_home": ("take-home", "take away"), "asm.body.complete_the_assessment": ("complete your short exercise", "complete your form"), "asm.body.assessment_vendor": ("codility", "code"), "asm.body.time_limit": ("you have 90 minutes to complete", "you have time"),
    "ack.subject.thanks_for_applying": ("thanks for applying", "thanks for coming"), "ack.subject.application_received": ("application confirmation", "application"), "ack.subject.we_got_your_application": ("we've got your application", "we've got mail"), "ack.body.thanks_for_applying": ("thank you for your interest", "thank you for the fish"), "ack.body.application_received": ("your application was received", "your application was lost"), "ack.body.reviewing_application": ("team is reviewing your application", "team is reviewing movies"), "ack.body.application_submitted": ("your application was successfully submitted", "your application was lost"),
    "rec.subject.opportunity": ("great opportunity", "opportunity"), "rec.subject.reaching_out": ("reaching out", "reaching in"), "rec.body.came_across_your_profile": ("stumbled upon your github", "stumbled upon your cat"), "rec.body.i_am_a_recruiter": ("i'm a technical recruiter", "i'm a cook"), "rec.body.would_you_be_interested": ("are you open to", "are you open"), "rec.body.we_are_hiring": ("we're currently hiring a", "we're currently closed"),
}
